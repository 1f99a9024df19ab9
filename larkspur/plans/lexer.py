"""Tokens of the dialect: case-insensitive keywords, raw string literals, ``--`` and ``/* */`` comments."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(Exception):
    """A statement that cannot be parsed or carried out."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, int, float, string, op, end
    text: str
    at: int


_PATTERN = re.compile(r"(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<float>\d+\.\d+)|(?P<int>\d+)|(?P<string>'(?:\\.|[^'\\])*')|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op><>|!=|<=|>=|\|\||[-+*/%=<>(),.;:])", re.S)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _PATTERN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0][1:-1] if m.lastgroup == "string" else m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]


def statements(script: str) -> list[str]:
    """Split a script at semicolons outside strings, comments, loops and trigger bodies."""
    out, begin, depth, words = [], 0, 0, []
    for t in tokenize(script):
        if t.kind == "word":
            w = t.text.upper()
            if w == "WHILE" and (not words or words[-1] != "END"):
                depth += 1
            elif w == "BEGIN" and "TRIGGER" in words:
                depth += 1
            elif w == "END" and depth and "CASE" not in words:
                depth -= 1
            if w == "CASE":
                words.append(w)
            elif w == "END" and "CASE" in words:
                words.reverse()
                words.remove("CASE")
                words.reverse()
            else:
                words.append(w)
        elif t.kind == "op" and t.text == ";" and depth == 0:
            if words:
                out.append(script[begin : t.at].strip())
            begin, words = t.at + 1, []
    if words:
        out.append(script[begin:].strip())
    return out
