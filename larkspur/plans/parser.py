"""Recursive-descent parser of the dialect."""

from __future__ import annotations

from larkspur.plans.ast import Expr, Query, Source, Statement
from larkspur.plans.lexer import SqlError, tokenize

TYPES = {"INT": "bigint", "INTEGER": "bigint", "FLOAT": "double", "DOUBLE": "double", "VARCHAR": "string", "TEXT": "string"}
STOP = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT ON JOIN INNER LEFT RIGHT FULL CROSS AND OR NOT AS SET WHEN THEN ELSE END USING VALUES DO IN IS LIKE BETWEEN ASC DESC OUTER CASE SELECT DISTINCT".split())
PRIVILEGES = frozenset("SELECT INSERT UPDATE DELETE ALTER DROP EXECUTE".split())
COMPARISONS = ("=", "!=", "<>", "<", ">", "<=", ">=")


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i = sql, tokenize(sql), 0

    # --- tokens ---
    @property
    def now(self):
        return self.tokens[self.i]

    def peek(self, *words: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return t.kind in ("word", "op") and t.text.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> str:
        if not self.peek(*words):
            raise SqlError(f"expected {' or '.join(words)} near {self.sql[self.now.at : self.now.at + 20]!r}")
        self.i += 1
        return self.tokens[self.i - 1].text.upper()

    def of_kind(self, kind: str) -> str:
        if self.now.kind != kind:
            raise SqlError(f"expected a {kind} near {self.sql[self.now.at : self.now.at + 20]!r}")
        self.i += 1
        return self.tokens[self.i - 1].text

    def name(self) -> str:
        return self.of_kind("word")

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # --- expressions, loosest first ---
    def expr(self) -> Expr:
        left = self.conjunction()
        while self.take("OR"):
            left = Expr("binary", "OR", [left, self.conjunction()])
        return left

    def conjunction(self) -> Expr:
        left = self.negation()
        while self.take("AND"):
            left = Expr("binary", "AND", [left, self.negation()])
        return left

    def negation(self) -> Expr:
        return Expr("unary", "NOT", [self.negation()]) if self.take("NOT") else self.predicate()

    def predicate(self) -> Expr:
        if self.take("EXISTS"):
            self.need("(")
            q = self.query()
            self.need(")")
            return Expr("exists", q)
        left = self.sum()
        for op in COMPARISONS:
            if self.take(op):
                op = "!=" if op == "<>" else op
                if self.peek("ANY", "SOME", "ALL") and self.peek("(", ahead=1):
                    every = self.need("ANY", "SOME", "ALL") == "ALL"
                    self.need("(")
                    q = self.query()
                    self.need(")")
                    out = Expr("quantified", op, [left], {"query": q, "every": every})
                else:
                    out = Expr("binary", op, [left, self.sum()])
                if self.peek(*COMPARISONS):
                    raise SqlError("comparisons do not chain")
                return out
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return Expr("null", negated, [left])
        negated = self.take("NOT")
        if self.take("LIKE"):
            out = Expr("like", None, [left, self.sum()])
        elif self.take("BETWEEN"):
            low = self.sum()
            self.need("AND")
            out = Expr("between", None, [left, low, self.sum()])
        elif self.take("IN"):
            self.need("(")
            if self.peek("SELECT", "WITH"):
                out = Expr("in", self.query(), [left])
            else:
                out = Expr("in", None, [left, *self.listed(self.expr)])
            self.need(")")
        elif negated:
            raise SqlError("expected LIKE, BETWEEN or IN after NOT")
        else:
            return left
        return Expr("unary", "NOT", [out]) if negated else out

    def sum(self) -> Expr:
        left = self.product()
        while self.peek("+", "-", "||"):
            op = self.need("+", "-", "||")
            left = Expr("binary", op, [left, self.product()])
        return left

    def product(self) -> Expr:
        left = self.factor()
        while self.peek("*", "/", "%"):
            op = self.need("*", "/", "%")
            left = Expr("binary", op, [left, self.factor()])
        return left

    def factor(self) -> Expr:
        return Expr("unary", "-", [self.factor()]) if self.take("-") else self.primary()

    def primary(self) -> Expr:
        t = self.now
        if t.kind in ("int", "float", "string"):
            self.i += 1
            return Expr("literal", {"int": int, "float": float, "string": str}[t.kind](t.text))
        if self.take("("):
            if self.peek("SELECT", "WITH"):
                out = Expr("subquery", self.query())
            else:
                out = self.expr()
            self.need(")")
            return out
        if self.take("NULL"):
            return Expr("literal", None)
        if self.take("TRUE"):
            return Expr("literal", True)
        if self.take("FALSE"):
            return Expr("literal", False)
        if self.take("*"):
            return Expr("star")
        if self.take("CASE"):
            base = None if self.peek("WHEN") else self.expr()
            arms = []
            while self.take("WHEN"):
                cond = self.expr()
                self.need("THEN")
                arms.append((cond, self.expr()))
            other = self.expr() if self.take("ELSE") else None
            self.need("END")
            return Expr("case", base, arms, {"other": other})
        name = self.name()
        if self.take("("):
            distinct = self.take("DISTINCT")
            args = [] if self.peek(")") else self.listed(self.expr)
            self.need(")")
            call = Expr("call", name, args, {"distinct": distinct})
            if self.take("OVER"):
                self.need("(")
                part, order = [], []
                if self.take("PARTITION"):
                    self.need("BY")
                    part = self.listed(self.expr)
                if self.take("ORDER"):
                    self.need("BY")
                    order = self.listed(self.order_key)
                self.need(")")
                return Expr("window", call, [], {"partition": part, "order": order})
            return call
        if self.take("."):
            if self.take("*"):
                return Expr("star", name)
            return Expr("column", self.name(), [], {"table": name})
        return Expr("column", name)

    def order_key(self) -> tuple[Expr, bool]:
        e = self.expr()
        up = not self.take("DESC")
        self.take("ASC")
        return e, up

    # --- queries ---
    def query(self) -> Query:
        ctes = []
        if self.take("WITH"):
            while True:
                name = self.name()
                self.need("AS")
                self.need("(")
                ctes.append((name, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        out = self.branch()
        while self.peek("UNION", "INTERSECT", "EXCEPT"):
            kind = self.need("UNION", "INTERSECT", "EXCEPT")
            if kind == "UNION" and self.take("ALL"):
                kind = "UNION ALL"
            out = Query(set_kind=kind, left=out, right=self.branch())
        if self.take("ORDER"):
            self.need("BY")
            out.order = self.listed(self.order_key)
        if self.take("LIMIT"):
            out.limit = int(self.of_kind("int"))
        if self.take("OFFSET"):
            out.offset = int(self.of_kind("int"))
        out.ctes = ctes
        return out

    def branch(self) -> Query:
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        self.need("SELECT")
        q = Query(distinct=self.take("DISTINCT"))
        q.items = self.listed(self.item)
        if self.take("FROM"):
            q.source = self.sources()
        if self.take("WHERE"):
            q.where = self.expr()
        if self.take("GROUP"):
            self.need("BY")
            q.group = self.listed(self.expr)
        if self.take("HAVING"):
            q.having = self.expr()
        return q

    def item(self) -> tuple[Expr, str | None]:
        e = self.expr()
        return e, self.alias()

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        if self.now.kind == "word" and self.now.text.upper() not in STOP:
            return self.name()
        return None

    def sources(self) -> Source:
        left = self.joined()
        while self.take(","):
            left = Source(join="CROSS", left=left, right=self.joined())
        return left

    def joined(self) -> Source:
        left = self.table()
        while True:
            if self.take("CROSS"):
                self.need("JOIN")
                left = Source(join="CROSS", left=left, right=self.table())
                continue
            kind = "INNER"
            if self.peek("LEFT", "RIGHT", "FULL"):
                kind = self.need("LEFT", "RIGHT", "FULL")
                self.take("OUTER")
                self.need("JOIN")
            elif self.take("INNER"):
                self.need("JOIN")
            elif not self.take("JOIN"):
                return left
            right = self.table()
            self.need("ON")
            left = Source(join=kind, left=left, right=right, on=self.expr())

    def table(self) -> Source:
        if self.take("("):
            q = self.query()
            self.need(")")
            return Source(query=q, alias=self.alias())
        return Source(name=self.name(), alias=self.alias())

    # --- statements ---
    def statement(self) -> Statement:
        out = self.one()
        self.take(";")
        if self.now.kind != "end":
            raise SqlError(f"unexpected {self.sql[self.now.at : self.now.at + 20]!r}")
        return out

    def one(self) -> Statement:
        if self.peek("SELECT", "WITH", "("):
            return Statement("select", {"query": self.query()})
        if self.take("EXPLAIN"):
            analyze = self.take("ANALYZE")
            dot = self.take("FORMAT") and bool(self.need("DOT"))
            return Statement("explain", {"analyze": analyze, "dot": dot, "query": self.query()})
        if self.take("BENCHMARK"):
            return Statement("benchmark", {"query": self.query()})
        if self.now.kind == "word" and self.peek(":", ahead=1):
            label = self.name()
            self.need(":")
            return self.loop(label)
        if self.peek("WHILE"):
            return self.loop(None)
        if self.peek("LEAVE", "ITERATE"):
            kind = self.need("LEAVE", "ITERATE").lower()
            return Statement(kind, {"label": self.name() if self.now.kind == "word" else None})
        if self.peek("BEGIN", "COMMIT", "ROLLBACK"):
            kind = self.need("BEGIN", "COMMIT", "ROLLBACK").lower()
            self.take("TRANSACTION")
            return Statement(kind)
        for word in ("CREATE", "ALTER", "DROP", "INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE", "RENAME", "LOAD", "GRANT", "REVOKE"):
            if self.take(word):
                return getattr(self, word.lower())()
        raise SqlError(f"not a statement: {self.sql[self.now.at : self.now.at + 20]!r}")

    def loop(self, label: str | None) -> Statement:
        self.need("WHILE")
        cond = self.expr()
        self.need("DO")
        body = []
        while not self.peek("END"):
            body.append(self.one())
            self.need(";")
        self.need("END")
        self.need("WHILE")
        return Statement("while", {"label": label, "condition": cond, "body": body})

    def column(self) -> dict:
        out = {"name": self.name(), "type": self.type(), "not_null": False, "primary": False, "unique": False, "default": None, "checks": [], "references": None}
        while True:
            if self.take("NOT"):
                self.need("NULL")
                out["not_null"] = True
            elif self.take("PRIMARY"):
                self.need("KEY")
                out["primary"] = out["not_null"] = out["unique"] = True
            elif self.take("UNIQUE"):
                out["unique"] = True
            elif self.take("DEFAULT"):
                out["default"] = self.factor()
            elif self.take("CHECK"):
                self.need("(")
                begin = self.now.at
                self.expr()
                out["checks"].append(self.sql[begin : self.now.at].strip())
                self.need(")")
            elif self.take("REFERENCES"):
                table = self.name()
                self.need("(")
                ref = {"table": table, "column": self.name(), "cascade": False}
                self.need(")")
                if self.take("ON"):
                    self.need("DELETE")
                    ref["cascade"] = self.need("CASCADE", "RESTRICT") == "CASCADE"
                out["references"] = ref
            else:
                return out

    def type(self) -> str:
        name = self.name().upper()
        if name not in TYPES:
            raise SqlError(f"no such type: {name}")
        if self.take("("):
            self.of_kind("int")
            self.need(")")
        return TYPES[name]

    def create(self) -> Statement:
        if self.take("TABLE"):
            name = self.name()
            self.need("(")
            columns = self.listed(self.column)
            self.need(")")
            return Statement("create_table", {"name": name, "columns": columns})
        if self.take("INDEX"):
            name = self.name()
            self.need("ON")
            table = self.name()
            self.need("(")
            column = self.name()
            self.need(")")
            return Statement("create_index", {"name": name, "table": table, "column": column, "using": self.need("HASH", "BTREE") if self.take("USING") else "BTREE"})
        materialized = self.take("MATERIALIZED")
        if self.take("VIEW"):
            name = self.name()
            self.need("AS")
            begin = self.now.at
            q = self.query()
            return Statement("create_view", {"name": name, "materialized": materialized, "query": q, "text": self.sql[begin : self.now.at].strip().rstrip(";")})
        if self.take("FUNCTION"):
            name = self.name()
            self.need("(")
            params = [] if self.peek(")") else self.listed(lambda: (self.name(), self.type()))
            self.need(")")
            self.need("RETURNS")
            kind = self.type()
            self.need("AS")
            body = Parser(self.of_kind("string")).expr() if self.now.kind == "string" else self.expr()
            return Statement("create_function", {"name": name, "params": params, "returns": kind, "body": body})
        if self.take("USER"):
            return self.user("create_user")
        self.need("TRIGGER")
        name = self.name()
        when, event = self.need("BEFORE", "AFTER"), self.need("INSERT", "UPDATE", "DELETE")
        self.need("ON")
        table = self.name()
        for w in ("FOR", "EACH", "ROW"):
            self.need(w)
        if self.take("EXECUTE"):
            body = [self.of_kind("string")]
        else:
            self.need("BEGIN")
            body = []
            while not self.take("END"):
                body.append(self.of_kind("string"))
                self.need(";")
        return Statement("create_trigger", {"name": name, "when": when, "event": event, "table": table, "body": body})

    def user(self, kind: str) -> Statement:
        name = self.name()
        self.need("IDENTIFIED")
        self.need("BY")
        return Statement(kind, {"name": name, "password": self.of_kind("string")})

    def alter(self) -> Statement:
        if self.take("USER"):
            return self.user("alter_user")
        self.need("TABLE")
        table = self.name()
        if self.take("ADD"):
            self.take("COLUMN")
            return Statement("add_column", {"table": table, "column": self.column()})
        if self.take("DROP"):
            self.take("COLUMN")
            return Statement("drop_column", {"table": table, "column": self.name()})
        self.need("RENAME")
        if self.take("TO"):
            return Statement("rename_table", {"table": table, "to": self.name()})
        self.take("COLUMN")
        column = self.name()
        self.need("TO")
        return Statement("rename_column", {"table": table, "column": column, "to": self.name()})

    def rename(self) -> Statement:
        self.need("TABLE")
        table = self.name()
        self.need("TO")
        return Statement("rename_table", {"table": table, "to": self.name()})

    def drop(self) -> Statement:
        kind = self.need("TABLE", "INDEX", "VIEW", "FUNCTION", "USER", "TRIGGER").lower()
        return Statement(f"drop_{kind}", {"name": self.name()})

    def truncate(self) -> Statement:
        self.take("TABLE")
        return Statement("truncate", {"table": self.name()})

    def load(self) -> Statement:
        return Statement("load", {"table": self.name(), "path": self.of_kind("string")})

    def row(self) -> list[Expr]:
        self.need("(")
        out = self.listed(self.expr)
        self.need(")")
        return out

    def insert(self) -> Statement:
        self.need("INTO")
        table, columns = self.name(), None
        if self.take("("):
            columns = self.listed(self.name)
            self.need(")")
        if self.peek("SELECT", "WITH"):
            return Statement("insert", {"table": table, "columns": columns, "query": self.query(), "rows": None})
        self.need("VALUES")
        return Statement("insert", {"table": table, "columns": columns, "rows": self.listed(self.row), "query": None})

    def assignment(self) -> tuple[str, Expr]:
        name = self.name()
        if self.take("."):
            name = self.name()
        self.need("=")
        return name, self.expr()

    def update(self) -> Statement:
        table = self.name()
        self.need("SET")
        sets = self.listed(self.assignment)
        return Statement("update", {"table": table, "sets": sets, "where": self.expr() if self.take("WHERE") else None})

    def delete(self) -> Statement:
        self.need("FROM")
        return Statement("delete", {"table": self.name(), "where": self.expr() if self.take("WHERE") else None})

    def merge(self) -> Statement:
        self.need("INTO")
        target, target_alias = self.name(), self.alias()
        self.need("USING")
        source = self.table()
        self.need("ON")
        on = self.expr()
        for w in ("WHEN", "MATCHED", "THEN", "UPDATE", "SET"):
            self.need(w)
        sets = self.listed(self.assignment)
        for w in ("WHEN", "NOT", "MATCHED", "THEN", "INSERT"):
            self.need(w)
        columns = None
        if self.take("("):
            columns = self.listed(self.name)
            self.need(")")
        self.need("VALUES")
        return Statement("merge", {"table": target, "alias": target_alias, "source": source, "on": on, "sets": sets, "columns": columns, "values": self.row()})

    def grant(self) -> Statement:
        return self.privilege("grant", "TO")

    def revoke(self) -> Statement:
        return self.privilege("revoke", "FROM")

    def privilege(self, kind: str, word: str) -> Statement:
        names = self.listed(lambda: self.need(*PRIVILEGES))
        self.need("ON")
        what = self.need("TABLE", "VIEW", "FUNCTION") if self.peek("TABLE", "VIEW", "FUNCTION") else "TABLE"
        name = self.name()
        self.need(word)
        return Statement(kind, {"privileges": names, "what": what, "name": name, "user": self.name()})


def parse(sql: str) -> Statement:
    return Parser(sql).statement()
