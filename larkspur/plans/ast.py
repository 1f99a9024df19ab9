"""Syntax trees: expressions, queries and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Expr:
    """kind: literal, column, star, unary, binary, call, case, between, in, like, null, exists, subquery, quantified, window."""

    kind: str
    value: Any = None
    args: list = field(default_factory=list)
    more: dict = field(default_factory=dict)


@dataclass
class Source:
    """A table, a derived table or a join of two sources."""

    name: str | None = None
    query: Query | None = None
    alias: str | None = None
    join: str | None = None
    left: Source | None = None
    right: Source | None = None
    on: Expr | None = None


@dataclass
class Query:
    items: list[tuple[Expr, str | None]] = field(default_factory=list)
    distinct: bool = False
    source: Source | None = None
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    ctes: list[tuple[str, Query]] = field(default_factory=list)
    set_kind: str | None = None
    left: Query | None = None
    right: Query | None = None


@dataclass
class Statement:
    """kind names the statement; its parts are in ``more``."""

    kind: str
    more: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        try:
            return self.__dict__["more"][name]
        except KeyError:
            raise AttributeError(name) from None


def tables_of(node) -> set[str]:
    """Names of all tables and views that a tree reads, subqueries included."""
    found: set[str] = set()
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Source) and x.name:
            found.add(x.name)
        if isinstance(x, (Expr, Source, Query)):
            todo += list(vars(x).values())
        elif isinstance(x, dict):
            todo += list(x.values())
        elif isinstance(x, (list, tuple)):
            todo += list(x)
    return found


def calls_of(node) -> set[str]:
    """Upper-cased names of all functions called in a tree."""
    found: set[str] = set()
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Expr) and x.kind == "call":
            found.add(x.value.upper())
        if isinstance(x, (Expr, Source, Query)):
            todo += list(vars(x).values())
        elif isinstance(x, dict):
            todo += list(x.values())
        elif isinstance(x, (list, tuple)):
            todo += list(x)
    return found
