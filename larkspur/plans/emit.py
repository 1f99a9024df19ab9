"""Syntax trees to Spark SQL text. The dialect's own rules live here; planning is Catalyst's."""

from __future__ import annotations

from collections.abc import Callable

from larkspur.functions.scalar import normal_pattern
from larkspur.plans.ast import Expr, Query, Source
from larkspur.plans.lexer import SqlError

AGGREGATES = frozenset(("COUNT", "SUM", "AVG", "MIN", "MAX"))
WINDOWS = frozenset(("ROW_NUMBER", "RANK", "DENSE_RANK"))
ARITY = {"LOWER": (1, 1), "UPPER": (1, 1), "LENGTH": (1, 1), "TRIM": (1, 1), "SUBSTR": (2, 3), "ABS": (1, 1), "ROUND": (1, 2), "CEIL": (1, 1), "CEILING": (1, 1), "FLOOR": (1, 1), "COALESCE": (1, 99), "NULLIF": (2, 2)}
BLANKS = r"' \t\n\r\u000b\u000c'"


def quoted(name: str) -> str:
    return f"`{name}`"


def text(value: str) -> str:
    """A string literal; backslashes stay as they are."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Emitter:
    """``schema_of`` gives {column: type} of a table name or of Spark SQL text."""

    def __init__(self, schema_of: Callable[[str], dict[str, str]], functions: dict[str, str] | None = None):
        self.schema_of, self.functions, self.count = schema_of, functions or {}, 0

    # --- queries ---
    def query(self, q: Query, outer: list | None = None, ctes: dict | None = None, first_row: bool = False) -> str:
        ctes = dict(ctes or {})
        withs = []
        for name, body in q.ctes:
            made = self.query(body, outer, ctes)
            ctes[name.lower()] = made
            withs.append(f"{quoted(name)} AS ({made})")
        if q.set_kind:
            left, right = self.query(q.left, outer, ctes), self.query(q.right, outer, ctes)
            body, scope = f"({left}) {q.set_kind} ({right})", []
        else:
            scope = [self.scope(q.source, outer, ctes), *(outer or [])] if q.source else list(outer or [])
            items = ", ".join(self.item(e, a, scope, ctes) for e, a in q.items)
            body = f"SELECT {'DISTINCT ' if q.distinct else ''}{items}"
            if q.source:
                body += f" FROM {self.source(q.source, scope, ctes)}"
            if q.where:
                body += f" WHERE {self.filter(q.where, scope, ctes)}"
            if q.group:
                body += " GROUP BY " + ", ".join(self.expr(e, scope, ctes) for e in q.group)
            if q.having:
                body += f" HAVING {self.expr(q.having, scope, ctes)}"
        if q.order:
            body += " ORDER BY " + ", ".join(self.order(e, up, scope, ctes) for e, up in q.order)
        limit = q.limit if q.limit is not None else 1 if first_row else None
        if limit is not None:
            body += f" LIMIT {min(limit, 1) if first_row else limit}"
        if q.offset:
            body += f" OFFSET {q.offset}"
        return (f"WITH {', '.join(withs)} " if withs else "") + body

    def item(self, e: Expr, alias: str | None, scope, ctes) -> str:
        made = self.expr(e, scope, ctes)
        return f"{made} AS {quoted(alias)}" if alias else made

    def order(self, e: Expr, up: bool, scope, ctes) -> str:
        return self.expr(e, scope, ctes) + (" ASC NULLS LAST" if up else " DESC NULLS FIRST")

    def source(self, s: Source, scope, ctes) -> str:
        if s.join:
            right = self.source(s.right, scope, ctes)
            if s.join == "CROSS":
                return f"{self.source(s.left, scope, ctes)} CROSS JOIN {right}"
            return f"{self.source(s.left, scope, ctes)} {s.join} JOIN {right} ON {self.expr(s.on, scope, ctes)}"
        if s.query:
            self.count += 1
            return f"({self.query(s.query, None, ctes)}) AS {quoted(s.alias or f'_t{self.count}')}"
        return quoted(s.name) + (f" AS {quoted(s.alias)}" if s.alias else "")

    def scope(self, s: Source, outer, ctes) -> dict[str, dict[str, str]]:
        """Types of the columns by table alias, lower-cased."""
        if s.join:
            return self.scope(s.left, outer, ctes) | self.scope(s.right, outer, ctes)
        if s.query:
            found = self.schema_of(self.defined(self.query(s.query, None, ctes), ctes))
        else:
            found = self.schema_of(self.defined(ctes[s.name.lower()], ctes) if s.name.lower() in ctes else quoted(s.name))
        return {(s.alias or s.name or f"_{id(s)}").lower(): {k.lower(): v for k, v in found.items()}}

    @staticmethod
    def defined(text: str, ctes: dict[str, str]) -> str:
        """A query that stands alone, the CTEs it may name written before it."""
        return f"WITH {', '.join(f'{quoted(n)} AS ({q})' for n, q in ctes.items())} SELECT * FROM ({text})" if ctes else text

    # --- types, as far as division needs them ---
    def integral(self, e: Expr, scope) -> bool:
        k = e.kind
        if k == "literal":
            return isinstance(e.value, int) and not isinstance(e.value, bool)
        if k == "column":
            table = (e.more.get("table") or "").lower()
            for tables in scope:
                for name, columns in tables.items():
                    if (not table or table == name) and e.value.lower() in columns:
                        return columns[e.value.lower()] in ("bigint", "int", "smallint", "tinyint")
            return False
        if k == "unary":
            return e.value == "-" and self.integral(e.args[0], scope)
        if k == "binary":
            return e.value in "+-*/%" and all(self.integral(x, scope) for x in e.args)
        if k == "case":
            values = [v for _, v in e.args] + ([e.more["other"]] if e.more["other"] else [])
            return all(self.integral(v, scope) or (v.kind == "literal" and v.value is None) for v in values)
        if k == "call":
            name = e.value.upper()
            if name in ("COUNT", "LENGTH", "CEIL", "CEILING", "FLOOR") or (name == "ROUND" and len(e.args) == 1):
                return True
            if name in ("SUM", "MIN", "MAX", "ABS", "COALESCE", "NULLIF"):
                return all(self.integral(x, scope) for x in e.args)
            return self.functions.get(name) == "bigint"
        if k == "window":
            return True
        if k == "subquery" and e.value.items:
            try:
                kinds = list(self.schema_of(self.query(e.value, scope)).values())
            except Exception:  # correlated: its types need the outer row
                inner = [self.scope(e.value.source, None, {}), *scope] if e.value.source else scope
                return self.integral(e.value.items[0][0], inner)
            return kinds[0] in ("bigint", "int")
        return False

    # --- expressions ---
    def expr(self, e: Expr, scope: list, ctes: dict | None = None) -> str:
        one = lambda x: self.expr(x, scope, ctes)
        k, v = e.kind, e.value
        if k == "literal":
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return "TRUE" if v else "FALSE"
            if isinstance(v, str):
                return text(v)
            return f"{v!r}D" if isinstance(v, float) else f"{v}L"
        if k == "column":
            return (quoted(e.more["table"]) + "." if e.more.get("table") else "") + quoted(v)
        if k == "star":
            return f"{quoted(v)}.*" if v else "*"
        if k == "unary":
            return f"(NOT {self.truth(e.args[0], scope, ctes)})" if v == "NOT" else f"(- {one(e.args[0])})"
        if k == "binary":
            a, b = e.args
            if v in ("AND", "OR"):
                return f"({self.truth(a, scope, ctes)} {v} {self.truth(b, scope, ctes)})"
            if v == "/":
                op = "div" if self.integral(a, scope) and self.integral(b, scope) else "/"
                return f"({one(a)} {op} nullif({one(b)}, 0))"
            if v == "%":
                return f"({one(a)} % nullif({one(b)}, 0))"
            return f"({one(a)} {v} {one(b)})"
        if k == "null":
            return f"({one(e.args[0])} IS {'NOT ' if v else ''}NULL)"
        if k == "between":
            a, lo, hi = map(one, e.args)
            return f"({a} BETWEEN {lo} AND {hi})"
        if k == "like":
            pattern = e.args[1]
            return f"({one(e.args[0])} LIKE {text(normal_pattern(pattern.value)) if pattern.kind == 'literal' else one(pattern)})"
        if k == "in":
            inner = self.query(v, scope, ctes) if v else ", ".join(one(x) for x in e.args[1:])
            return f"({one(e.args[0])} IN ({inner}))"
        if k == "exists":
            return f"EXISTS ({self.query(v, scope, ctes)})"
        if k == "subquery":
            return f"({self.query(v, scope, ctes, first_row=True)})" if not self.single(v) else f"({self.query(v, scope, ctes)})"
        if k == "quantified":
            return self.quantified(e, scope, ctes)
        if k == "case":
            base = f" {one(v)}" if v else ""
            arms = "".join(f" WHEN {one(c) if v else self.truth(c, scope, ctes)} THEN {one(r)}" for c, r in e.args)
            other = f" ELSE {one(e.more['other'])}" if e.more["other"] else ""
            return f"CASE{base}{arms}{other} END"
        if k == "window":
            return self.window(e, scope, ctes)
        if k == "call":
            return self.call(e, scope, ctes)
        raise SqlError(f"cannot emit {k}")

    @staticmethod
    def single(q: Query) -> bool:
        """A global aggregate gives one row, so no LIMIT is needed."""
        return not q.set_kind and not q.group and len(q.items) == 1 and q.items[0][0].kind == "call" and q.items[0][0].value.upper() in AGGREGATES

    def truth(self, e: Expr, scope, ctes) -> str:
        """A condition; a bare number is true unless 0."""
        made = self.expr(e, scope, ctes)
        return f"({made} <> 0)" if self.integral(e, scope) else made

    def filter(self, e: Expr, scope, ctes=None) -> str:
        """A WHERE condition: there only true counts, so ANY plans as a semi join and ALL as an anti join."""
        if e.kind == "binary" and e.value == "AND":
            return f"({self.filter(e.args[0], scope, ctes)} AND {self.filter(e.args[1], scope, ctes)})"
        if e.kind != "quantified":
            return self.truth(e, scope, ctes)
        x, op, inner, made = self.compared(e, scope, ctes)
        if self.alone(made, ctes):
            if op == "=" and not e.more["every"]:
                return f"EXISTS ({inner} {x} = {made[1]})"
            if op in ("<>", "!=") and e.more["every"]:
                row = self.bounds(made)
                return f"(NOT EXISTS ({inner} {x} = {made[1]}) AND ({row}.n = 0 OR ({row}.n = {row}.k AND {x} IS NOT NULL)))"
            return self.by_bounds(x, op, e.more["every"], self.bounds(made))
        test = f"{x} {op} {made[1]}"
        return f"(NOT EXISTS ({inner} NOT coalesce({test}, FALSE)))" if e.more["every"] else f"EXISTS ({inner} {test})"

    def compared(self, e: Expr, scope, ctes) -> tuple[str, str, str, tuple[str, str]]:
        """The left side, the operator, a SELECT up to its condition over the subquery's rows, the subquery and its column."""
        self.count += 1
        s, c = f"_q{self.count}", f"_c{self.count}"
        made = self.query(e.more["query"], scope, ctes)
        return self.expr(e.args[0], scope, ctes), e.value, f"SELECT 1 FROM (SELECT * FROM ({made})) AS {s}({c}) WHERE", (made, f"{s}.{c}")

    def alone(self, made: tuple[str, str], ctes) -> bool:
        """Whether the subquery needs no outer row."""
        try:
            self.schema_of(self.defined(made[0], ctes or {}))
        except Exception:  # Spark finds a column that only the outer query has
            return False
        return True

    @staticmethod
    def bounds(made: tuple[str, str]) -> str:
        """One row of what a comparison with all or any of the values needs: rows, known values, least, greatest."""
        return f"(SELECT struct(count(*) AS n, count(c) AS k, min(c) AS lo, max(c) AS hi) FROM (SELECT * FROM ({made[0]})) AS b(c))"

    @staticmethod
    def by_bounds(x: str, op: str, every: bool, row: str) -> str:
        """Ordered comparisons, and those that equality decides by both bounds, three-valued, without pairs."""
        op = "<>" if op == "!=" else op
        lo, hi = f"{row}.lo", f"{row}.hi"
        if every:
            holds = {"=": f"({x} = {lo} AND {x} = {hi})", "<": f"({x} < {lo})", "<=": f"({x} <= {lo})", ">": f"({x} > {hi})", ">=": f"({x} >= {hi})"}[op]
            return f"(CASE WHEN {row}.n = 0 THEN TRUE WHEN {row}.k > 0 AND NOT {holds} THEN FALSE WHEN {row}.n > {row}.k THEN NULL ELSE {holds} END)"
        holds = {"<>": f"({x} <> {lo} OR {x} <> {hi})", "<": f"({x} < {hi})", "<=": f"({x} <= {hi})", ">": f"({x} > {lo})", ">=": f"({x} >= {lo})"}[op]
        return f"(CASE WHEN {row}.n = 0 THEN FALSE WHEN {row}.k > 0 AND {holds} THEN TRUE WHEN {row}.n > {row}.k THEN NULL ELSE {holds} END)"

    def quantified(self, e: Expr, scope, ctes) -> str:
        """Three-valued ANY and ALL: also right where the predicate is projected or negated."""
        x, op, inner, made = self.compared(e, scope, ctes)
        every, equal, c = e.more["every"], (op == "=") != e.more["every"] and op in ("=", "<>", "!="), made[1]
        if self.alone(made, ctes):
            row = self.bounds(made)
            if equal:  # = ANY, <> ALL
                return f"(CASE WHEN EXISTS ({inner} {x} = {c}) THEN {'FALSE' if every else 'TRUE'} WHEN {row}.n > {row}.k OR ({row}.n > 0 AND {x} IS NULL) THEN NULL ELSE {'TRUE' if every else 'FALSE'} END)"
            return self.by_bounds(x, op, every, row)
        unknown = f"EXISTS ({inner} ({x} {op} {c}) IS NULL)"
        if every:
            return f"(CASE WHEN EXISTS ({inner} NOT ({x} {op} {c})) THEN FALSE WHEN {unknown} THEN NULL ELSE TRUE END)"
        return f"(CASE WHEN EXISTS ({inner} {x} {op} {c}) THEN TRUE WHEN {unknown} THEN NULL ELSE FALSE END)"

    def window(self, e: Expr, scope, ctes) -> str:
        name = e.value.value.upper()
        if name not in WINDOWS and name not in AGGREGATES:
            raise SqlError(f"{name} is not a window function")
        if e.value.more["distinct"]:
            raise SqlError("DISTINCT does not go with a window")
        if name in ("RANK", "DENSE_RANK") and not e.more["order"]:
            return "1L"
        parts = []
        if e.more["partition"]:
            parts.append("PARTITION BY " + ", ".join(self.expr(x, scope, ctes) for x in e.more["partition"]))
        if e.more["order"]:
            parts.append("ORDER BY " + ", ".join(self.order(x, up, scope, ctes) for x, up in e.more["order"]))
        elif name == "ROW_NUMBER":
            parts.append("ORDER BY 1")
        return f"CAST({self.call(e.value, scope, ctes)} OVER ({' '.join(parts)}) AS BIGINT)" if name in WINDOWS else f"{self.call(e.value, scope, ctes)} OVER ({' '.join(parts)})"

    def call(self, e: Expr, scope, ctes) -> str:
        name = e.value.upper()
        args = [self.expr(x, scope, ctes) for x in e.args]
        if name in ARITY:
            low, high = ARITY[name]
            if not low <= len(args) <= high:
                raise SqlError(f"{name} takes {low}{f' to {high}' if high > low else ''} arguments")
        if name in AGGREGATES:
            return f"{name}({'DISTINCT ' if e.more['distinct'] else ''}{', '.join(args)})"
        if name in self.functions or name in WINDOWS:
            return f"{e.value}({', '.join(args)})"
        if name == "LENGTH":
            return f"CAST(octet_length({args[0]}) AS BIGINT)"
        if name == "TRIM":
            return f"btrim({args[0]}, {BLANKS})"
        if name == "SUBSTR":
            s, start = args[:2]
            at = f"CAST(CASE WHEN {start} < 0 THEN greatest({start}, - length({s})) WHEN {start} = 0 THEN 1 ELSE {start} END AS INT)"
            return f"substr({s}, {at}{f', CAST(greatest({args[2]}, 0) AS INT)' if len(args) > 2 else ''})"
        if name == "ROUND":
            digits = e.args[1].value if len(args) > 1 and e.args[1].kind == "literal" else args[1] if len(args) > 1 else None
            return f"CAST(round({args[0]}) AS BIGINT)" if digits is None else f"CAST(round({args[0]}, {digits}) AS DOUBLE)"
        if name in ("CEIL", "CEILING", "FLOOR"):
            return f"CAST({name}({args[0]}) AS BIGINT)"
        return f"{e.value}({', '.join(args)})"
