"""Session: statements in, DataFrames or messages out.

SELECT goes from syntax tree to Spark SQL text and is planned by Catalyst. Changes are set-based: a statement computes
its new rows as a DataFrame, constraints are queries that must find nothing, and the catalog is swapped at the end, so
every statement is atomic. Inside BEGIN ... COMMIT the swap waits for COMMIT.
"""

from __future__ import annotations

import copy
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalog import Store, column_of, verifier
from larkspur.plans import explain
from larkspur.plans.ast import Expr, Query, Statement, calls_of, tables_of
from larkspur.plans.emit import Emitter, quoted
from larkspur.plans.lexer import SqlError, statements
from larkspur.plans.parser import Parser, parse
from larkspur.sources.csv import read_csv

SUPERUSER = "ADMIN"
IN_TRANSACTION = frozenset("select explain benchmark insert update delete merge begin commit rollback create_user alter_user drop_user grant revoke while leave iterate".split())
MAX_LOOPS, MAX_TRIGGERS = 100_000, 16


class Leave(Exception):
    def __init__(self, label):
        self.label = label


class Iterate(Leave):
    pass


def default_root(spark: SparkSession) -> str:
    """A new database: in the cluster's shared folder, or in a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share, or name the database's folder")
    return f"{shared.rstrip('/')}/larkspur-db-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="larkspur-db-")


class Session:
    """One user's connection to the database in ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None, user: str = SUPERUSER):
        self.spark = spark.newSession()
        self.store = Store(self.spark, root or default_root(spark))
        self.user, self.id = user.upper(), uuid.uuid4().hex
        self.catalog, self.open, self.base = self.store.load(), False, 0
        self.depth, self.loops, self.bound = 0, 0, {}
        self.sync()

    # --- entry ---
    def run(self, script: str) -> list:
        """Every statement of a script; the first error ends it."""
        return [self.execute(s) for s in statements(script)]

    def execute(self, sql: str) -> DataFrame | str:
        statement = parse(sql)
        if self.open and statement.kind not in IN_TRANSACTION:
            raise SqlError(f"{statement.kind.replace('_', ' ').upper()} is not allowed in a transaction")
        if not self.open and self.depth == 0:
            self.catalog = self.store.load()
            self.sync()
        try:
            out = self.perform(statement)
            if not self.open and self.depth == 0 and statement.kind not in ("select", "explain", "benchmark", "begin", "commit", "rollback", "while"):
                self.publish()
            return out
        except Exception:
            if not self.open and self.depth == 0:
                self.catalog = self.store.load()
                self.sync()
            raise
        finally:
            if not self.open and self.depth == 0:
                self.store.locks.release(self.id)
            elif self.open and statement.kind in ("select", "explain", "benchmark"):
                self.store.locks.release(self.id, reads_only=True)

    def perform(self, s: Statement):
        self.allowed(s)
        return getattr(self, "do_" + s.kind)(s)

    def publish(self) -> None:
        self.store.publish(self.catalog, self.store.load()["version"] if not self.open else self.base)

    def attach(self, name: str, path: str) -> None:
        """A read-only table on Parquet files outside the database, for this session."""
        self.spark.read.parquet(path).createOrReplaceTempView(name)

    # --- names ---
    def sync(self) -> None:
        """Bind temporary views and functions to the catalog's present versions."""
        wanted = {}
        for name, t in self.catalog["tables"].items():
            wanted[name] = ("table", str((t["segments"], t["columns"])))
        for name, v in self.catalog["views"].items():
            if not v["materialized"]:
                wanted[name] = ("view", v["text"])
        for name in [n for n in self.bound if n not in wanted]:
            self.spark.catalog.dropTempView(name)
            del self.bound[name]
        for f in self.catalog["functions"].values():
            self.spark.sql(f["sql"])
        changed = False
        for name, mark in wanted.items():
            if mark[0] == "table" and self.bound.get(name) != mark:
                self.store.read(self.catalog["tables"][name]).createOrReplaceTempView(name)
                self.bound[name], changed = mark, True
        for name, mark in wanted.items():
            if mark[0] == "view" and (changed or self.bound.get(name) != mark):
                self.sql(Parser(mark[1]).query()).createOrReplaceTempView(name)
                self.bound[name] = mark

    def table(self, name: str) -> dict:
        for key, t in self.catalog["tables"].items():
            if key.lower() == name.lower():
                return t
        raise SqlError(f"no such table: {name}")

    def key(self, name: str) -> str:
        return next((k for k in self.catalog["tables"] if k.lower() == name.lower()), name)

    def rows(self, name: str) -> DataFrame:
        return self.spark.table(quoted(self.key(name)))

    @property
    def emitter(self) -> Emitter:
        schema_of = lambda text: {f.name: f.dataType.simpleString() for f in (self.spark.table(text) if text.startswith("`") else self.spark.sql(text)).schema}
        return Emitter(schema_of, {n: f["returns"] for n, f in self.catalog["functions"].items()})

    def sql(self, q: Query) -> DataFrame:
        return self.spark.sql(self.emitter.query(q))

    def scope(self, *pairs: tuple[str, str]) -> list:
        """Column types under the given aliases: (alias, table)."""
        return [{alias.lower(): {f.name.lower(): f.dataType.simpleString() for f in self.rows(t).schema} for alias, t in pairs}]

    # --- SELECT and plans ---
    def do_select(self, s):
        for t in tables_of(s.query):
            self.store.locks.read(t.lower(), self.id)
        return self.sql(s.query)

    def do_explain(self, s):
        df = self.sql(s.query)
        if s.dot:
            return explain.dot(df)
        return explain.analyze(df) if s.analyze else explain.text(df)

    def do_benchmark(self, s):
        return explain.benchmark(self.spark, self.emitter.query(s.query))

    # --- tables ---
    def do_create_table(self, s):
        if s.name.lower() in {x.lower() for x in [*self.catalog["tables"], *self.catalog["views"]]}:
            raise SqlError(f"{s.name} exists already")
        names = [c["name"].lower() for c in s.columns]
        if len(set(names)) < len(names):
            raise SqlError("a column is named twice")
        columns = []
        for c in s.columns:
            if c["references"]:
                column_of(self.table(c["references"]["table"]), c["references"]["column"])
            default = self.constant(c["default"]) if c["default"] else None
            columns.append(c | {"default": default, "stored": c["name"]})
        t = {"columns": columns, "segments": [], "indexes": []}
        self.catalog["tables"][s.name] = t
        self.catalog["owners"][s.name.lower()] = self.user
        for c in columns:
            if c["primary"]:
                t["indexes"].append({"name": f"pk_{s.name}_{c['name']}", "column": c["name"], "using": "BTREE"})
        self.sync()
        return f"table {s.name} created"

    def do_drop_table(self, s):
        key = self.key(s.name)
        self.table(s.name)
        for other, t in self.catalog["tables"].items():
            if other != key and any(c["references"] and c["references"]["table"].lower() == s.name.lower() for c in t["columns"]):
                raise SqlError(f"{other} refers to {s.name}")
        self.catalog["triggers"] = {n: g for n, g in self.catalog["triggers"].items() if g["table"].lower() != s.name.lower()}
        self.forget(s.name)
        del self.catalog["tables"][key]
        self.sync()
        return f"table {s.name} dropped"

    def forget(self, name: str) -> None:
        self.catalog["grants"] = [g for g in self.catalog["grants"] if g["name"].lower() != name.lower()]
        self.catalog["owners"].pop(name.lower(), None)

    def do_truncate(self, s):
        t = self.table(s.table)
        self.store.locks.write(s.table.lower(), self.id)
        t["segments"] = []
        self.sync()
        return f"table {s.table} truncated"

    def do_rename_table(self, s):
        key = self.key(s.table)
        self.table(s.table)
        if s.to.lower() in {x.lower() for x in [*self.catalog["tables"], *self.catalog["views"]]}:
            raise SqlError(f"{s.to} exists already")
        self.catalog["tables"] = {s.to if k == key else k: v for k, v in self.catalog["tables"].items()}
        for t in self.catalog["tables"].values():
            for c in t["columns"]:
                if c["references"] and c["references"]["table"].lower() == key.lower():
                    c["references"]["table"] = s.to
        for g in [*self.catalog["triggers"].values()]:
            g["table"] = s.to if g["table"].lower() == key.lower() else g["table"]
        for g in self.catalog["grants"]:
            g["name"] = s.to if g["name"].lower() == key.lower() else g["name"]
        if key.lower() in self.catalog["owners"]:
            self.catalog["owners"][s.to.lower()] = self.catalog["owners"].pop(key.lower())
        self.sync()
        return f"table {s.table} renamed to {s.to}"

    def do_add_column(self, s):
        t = self.table(s.table)
        name = s.column["name"]
        if any(c["name"].lower() == name.lower() for c in t["columns"]):
            raise SqlError(f"{name} exists already")
        if s.column["not_null"] and t["segments"]:
            raise SqlError("a new column of a table with rows is NULL, so it cannot be NOT NULL")
        used = {c["stored"] for c in t["columns"]} | set(t.get("gone", []))
        stored = name if name not in used else f"{name}_{uuid.uuid4().hex[:8]}"
        t["columns"].append(s.column | {"stored": stored, "default": self.constant(s.column["default"]) if s.column["default"] else None})
        self.sync()
        return f"column {name} added"

    def do_drop_column(self, s):
        t = self.table(s.table)
        c = column_of(t, s.column)
        if len(t["columns"]) == 1:
            raise SqlError("a table keeps at least one column")
        for other in self.catalog["tables"].values():
            if any(x["references"] and x["references"]["table"].lower() == s.table.lower() and x["references"]["column"].lower() == s.column.lower() for x in other["columns"]):
                raise SqlError(f"{s.column} is referred to")
        t["columns"].remove(c)
        t.setdefault("gone", []).append(c["stored"])
        t["indexes"] = [i for i in t["indexes"] if i["column"].lower() != s.column.lower()]
        self.sync()
        return f"column {s.column} dropped"

    def do_rename_column(self, s):
        t = self.table(s.table)
        c = column_of(t, s.column)
        if any(x["name"].lower() == s.to.lower() for x in t["columns"]):
            raise SqlError(f"{s.to} exists already")
        for x in t["columns"]:
            if any(s.column.lower() in check.lower() for check in x["checks"]):
                raise SqlError(f"a CHECK names {s.column}")
        c["name"] = s.to
        for i in t["indexes"]:
            i["column"] = s.to if i["column"].lower() == s.column.lower() else i["column"]
        for other in self.catalog["tables"].values():
            for x in other["columns"]:
                if x["references"] and x["references"]["table"].lower() == s.table.lower() and x["references"]["column"].lower() == s.column.lower():
                    x["references"]["column"] = s.to
        self.sync()
        return f"column {s.column} renamed to {s.to}"

    def do_create_index(self, s):
        t = self.table(s.table)
        column_of(t, s.column)
        if any(i["name"].lower() == s.name.lower() for x in self.catalog["tables"].values() for i in x["indexes"]):
            raise SqlError(f"index {s.name} exists already")
        t["indexes"].append({"name": s.name, "column": column_of(t, s.column)["name"], "using": s.using})
        if t["segments"]:
            self.replace(s.table, self.rows(s.table))
        return f"index {s.name} created"

    def do_drop_index(self, s):
        for t in self.catalog["tables"].values():
            for i in t["indexes"]:
                if i["name"].lower() == s.name.lower():
                    t["indexes"].remove(i)
                    return f"index {s.name} dropped"
        raise SqlError(f"no such index: {s.name}")

    # --- views and functions ---
    def do_create_view(self, s):
        if s.name.lower() in {x.lower() for x in [*self.catalog["tables"], *self.catalog["views"]]}:
            raise SqlError(f"{s.name} exists already")
        df = self.sql(s.query)
        self.catalog["owners"][s.name.lower()] = self.user
        if s.materialized:
            kinds = {"int": "bigint", "boolean": "bigint"}
            columns = [{"name": f.name, "stored": f.name, "type": k if (k := kinds.get(f.dataType.simpleString(), f.dataType.simpleString())) in ("bigint", "double", "string") else "string", "not_null": False, "primary": False, "unique": False, "default": None, "checks": [], "references": None} for f in df.schema]
            self.catalog["tables"][s.name] = {"columns": columns, "segments": [], "indexes": []}
            self.replace(s.name, df)
        self.catalog["views"][s.name] = {"text": s.text, "materialized": s.materialized}
        self.sync()
        return f"view {s.name} created"

    def do_drop_view(self, s):
        key = next((v for v in self.catalog["views"] if v.lower() == s.name.lower()), None)
        if key is None:
            raise SqlError(f"no such view: {s.name}")
        if self.catalog["views"].pop(key)["materialized"]:
            self.catalog["tables"].pop(self.key(s.name))
        self.forget(s.name)
        self.sync()
        return f"view {s.name} dropped"

    def do_create_function(self, s):
        name = s.name.upper()
        if name in self.catalog["functions"]:
            raise SqlError(f"function {s.name} exists already")
        params = [p.lower() for p, _ in s.params]
        if len(set(params)) < len(params):
            raise SqlError("a parameter is named twice")
        body = self.emitter.expr(s.body, [{"": dict(zip(params, (k for _, k in s.params), strict=True))}])
        text = f"CREATE OR REPLACE TEMPORARY FUNCTION {s.name}({', '.join(f'{p} {k}' for p, k in s.params)}) RETURNS {s.returns} RETURN {body}"
        self.spark.sql(text)
        self.catalog["functions"][name] = {"sql": text, "returns": s.returns, "name": s.name}
        self.catalog["owners"][s.name.lower()] = self.user
        return f"function {s.name} created"

    def do_drop_function(self, s):
        if self.catalog["functions"].pop(s.name.upper(), None) is None:
            raise SqlError(f"no such function: {s.name}")
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {s.name}")
        self.forget(s.name)
        return f"function {s.name} dropped"

    # --- rows ---
    def constant(self, e: Expr):
        return self.spark.sql(f"SELECT {self.emitter.expr(e, [])} AS v").first()[0]

    def typed(self, t: dict, df: DataFrame) -> DataFrame:
        """Columns by position, cast to the table's types."""
        return df.select(*[F.col(f"`{have}`").cast(c["type"]).alias(c["stored"]) for have, c in zip(df.columns, t["columns"], strict=True)])

    def replace(self, name: str, df: DataFrame) -> None:
        """A new version of the whole table."""
        t = self.table(name)
        self.store.locks.write(name.lower(), self.id)
        t["segments"] = [self.store.write(self.typed(t, df), t)]
        self.sync()

    def must_be_empty(self, df: DataFrame, what: str) -> None:
        if df.limit(1).count():
            raise SqlError(what)

    def check(self, name: str, fresh: DataFrame, rest: DataFrame) -> None:
        """Constraints of changed rows (``fresh``) beside the table's unchanged rows (``rest``), which hold by themselves."""
        t = self.table(name)
        fresh.createOrReplaceTempView("_fresh")
        types = {f.name.lower(): f.dataType.simpleString() for f in fresh.schema}
        for c in t["columns"]:
            at = F.col(f"`{c['name']}`")
            if c["not_null"]:
                self.must_be_empty(fresh.where(at.isNull()), f"NOT NULL: {name}.{c['name']}")
            if c["unique"]:
                unique, key = f"UNIQUE: {name}.{c['name']}", fresh.where(at.isNotNull()).select(at.alias("_key"))
                self.must_be_empty(key.groupBy("_key").count().where("count > 1"), unique)
                self.must_be_empty(rest.select(at.alias("_have")).join(key, F.col("_have") == F.col("_key"), "left_semi"), unique)
            for text in c["checks"]:
                made = self.emitter.expr(Parser(text).expr(), [{"": types}])
                self.must_be_empty(self.spark.sql(f"SELECT 1 FROM _fresh WHERE NOT ({made})"), f"CHECK: {text}")
            if c["references"]:
                ref = c["references"]
                parent = rest.unionByName(fresh) if ref["table"].lower() == name.lower() else self.rows(ref["table"])
                keys = parent.select(F.col(f"`{ref['column']}`").alias("_key"))
                self.must_be_empty(fresh.where(at.isNotNull()).join(keys, at == F.col("_key"), "left_anti"), f"FOREIGN KEY: {name}.{c['name']} refers to {ref['table']}.{ref['column']}")

    def check_parents(self, name: str, whole: DataFrame) -> None:
        """After an update: keys that children refer to must still be there."""
        for child, c in self.children(name):
            keys = whole.select(F.col(f"`{c['references']['column']}`").alias("_key"))
            at = F.col(f"`{c['name']}`")
            self.must_be_empty(self.rows(child).where(at.isNotNull()).join(keys, at == F.col("_key"), "left_anti"), f"FOREIGN KEY: {child}.{c['name']} refers to {name}")

    def children(self, name: str) -> list[tuple[str, dict]]:
        return [(k, c) for k, t in self.catalog["tables"].items() for c in t["columns"] if c["references"] and c["references"]["table"].lower() == name.lower()]

    def do_insert(self, s):
        t = self.table(s.table)
        self.store.locks.write(s.table.lower(), self.id)
        names = [c["name"] for c in t["columns"]]
        given = [column_of(t, c)["name"] for c in s.columns] if s.columns else names
        if s.query:
            df = self.sql(s.query)
            if len(df.columns) != len(given):
                raise SqlError(f"{len(given)} columns, {len(df.columns)} values")
            df = df.toDF(*given)
        else:
            if any(len(r) != len(given) for r in s.rows):
                raise SqlError(f"a row needs {len(given)} values")
            e = self.emitter
            rows = ", ".join("(" + ", ".join(e.expr(x, []) for x in r) + ")" for r in s.rows)
            df = self.spark.sql(f"SELECT * FROM VALUES {rows} AS v({', '.join(quoted(g) for g in given)})")
        for c in t["columns"]:
            if c["name"] not in given:
                df = df.withColumn(c["name"], F.lit(c["default"]).cast(c["type"]))
        df = df.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(c["name"]) for c in t["columns"]])
        self.fire("BEFORE", "INSERT", s.table)
        return f"{self.append(s.table, df)} rows inserted" + self.fired("INSERT", s.table)

    def append(self, name: str, df: DataFrame) -> int:
        """Write the rows first, then check what was written, then name it in the catalog."""
        t = self.table(name)
        segment = self.store.write(self.typed(t, df), t)
        fresh = self.store.read(t | {"segments": [segment]})
        count = fresh.count()
        self.check(name, fresh, self.rows(name))
        if count:
            t["segments"] = [*t["segments"], segment]
        self.sync()
        return count

    def do_load(self, s):
        t = self.table(s.table)
        self.store.locks.write(s.table.lower(), self.id)
        df = read_csv(self.spark, s.path, [(c["name"], c["type"]) for c in t["columns"]])
        return f"{self.append(s.table, df)} rows loaded"

    def do_update(self, s):
        t = self.table(s.table)
        key = self.key(s.table)
        self.store.locks.write(s.table.lower(), self.id)
        self.fire("BEFORE", "UPDATE", s.table)
        t = self.table(s.table)
        e, scope = self.emitter, self.scope((key, key))
        sets = {column_of(t, c)["name"]: e.expr(x, scope) for c, x in s.sets}
        cond = e.truth(s.where, scope, None) if s.where else "TRUE"
        items = ", ".join(f"CAST({sets[c['name']]} AS {c['type']}) AS {quoted(c['name'])}" if c["name"] in sets else quoted(c["name"]) for c in t["columns"])
        changed = self.spark.sql(f"SELECT {items} FROM {quoted(key)} WHERE {cond}")
        segment = self.store.write(self.typed(t, changed), t)
        fresh = self.store.read(t | {"segments": [segment]})
        count = fresh.count()
        if count:
            rest = self.spark.sql(f"SELECT * FROM {quoted(key)} WHERE NOT coalesce({cond}, FALSE)")
            keep = self.store.write(self.typed(t, rest), t)
            whole = self.store.read(t | {"segments": [keep, segment]})
            self.check(s.table, fresh, self.store.read(t | {"segments": [keep]}))
            self.check_parents(s.table, whole)
            t["segments"] = [keep, segment]
            self.sync()
        return f"{count} rows updated" + self.fired("UPDATE", s.table)

    def do_delete(self, s):
        key = self.key(s.table)
        self.table(s.table)
        self.store.locks.write(s.table.lower(), self.id)
        self.fire("BEFORE", "DELETE", s.table)
        e = self.emitter
        cond = e.truth(s.where, self.scope((key, key)), None) if s.where else "TRUE"
        victims = self.spark.sql(f"SELECT * FROM {quoted(key)} WHERE {cond}")
        count = victims.count()
        if count:
            self.remove(key, victims, self.spark.sql(f"SELECT * FROM {quoted(key)} WHERE NOT coalesce({cond}, FALSE)"))
        return f"{count} rows deleted" + self.fired("DELETE", s.table)

    def remove(self, name: str, victims: DataFrame, rest: DataFrame) -> None:
        """Delete with cascades: all tables' remaining rows are found before anything is published.

        Children lose the rows that refer to a key of the parent's lost rows that no remaining row has; the loop ends
        when no table loses rows any more. RESTRICT fails before the catalog changes.
        """
        left = {name: self.settled(name, rest)}
        todo = [(name, victims)]
        while todo:
            parent, gone = todo.pop()
            for child, c in self.children(parent):
                now = left.get(child, self.rows(child))
                at, ref = F.col(f"`{c['name']}`"), c["references"]["column"]
                lost = gone.select(F.col(f"`{ref}`").alias("_key")).where("_key is not null").distinct()
                if not column_of(self.table(parent), ref)["unique"]:
                    have = left[parent].select(F.col(f"`{ref}`").alias("_have"))
                    still = have.join(lost, F.col("_have") == F.col("_key"), "left_semi").distinct()
                    lost = lost.join(still, F.col("_key") == F.col("_have"), "left_anti")
                hit = now.join(lost, at == F.col("_key"), "left_semi")
                if not hit.limit(1).count():
                    continue
                if not c["references"]["cascade"]:
                    raise SqlError(f"RESTRICT: {child}.{c['name']} refers to {parent}")
                left[child] = self.settled(child, now.join(lost, at == F.col("_key"), "left_anti"))
                self.store.locks.write(child.lower(), self.id)
                todo.append((child, hit))
        for table, df in left.items():
            self.table(table)["segments"] = [df.larkspur_segment] if isinstance(df, _Kept) else []
        self.sync()

    def settled(self, name: str, df: DataFrame) -> _Kept:
        t = self.table(name)
        segment = self.store.write(self.typed(t, df), t)
        return _Kept(self.store.read(t | {"segments": [segment]}), segment)

    def do_merge(self, s):
        t, key = self.table(s.table), self.key(s.table)
        self.store.locks.write(s.table.lower(), self.id)
        e = self.emitter
        target = s.alias or key
        source = e.source(s.source, [], {})
        named = s.source.alias or s.source.name
        scope = [self.scope((target, key))[0] | e.scope(s.source, None, {})]
        on = e.expr(s.on, scope)
        names = [c["name"] for c in t["columns"]]
        given = [column_of(t, c)["name"] for c in s.columns] if s.columns else names
        if len(s.values) != len(given):
            raise SqlError(f"a row needs {len(given)} values")
        sets = {column_of(t, c)["name"]: e.expr(x, scope) for c, x in s.sets}
        values = dict(zip(given, (e.expr(x, scope) for x in s.values), strict=True))
        # one full outer join, written once: target columns t0.., updated ones u0.., inserted ones v0.., and what matched
        row, seen = f"_row_{self.id}", f"_seen_{self.id}"
        rows = f"(SELECT *, monotonically_increasing_id() AS {row} FROM {quoted(key)}) AS {quoted(target)}"
        tagged = f"(SELECT *, TRUE AS {seen} FROM {source}) AS {quoted(named)}"
        kinds = [column_of(t, n)["type"] for n in names]
        old = [f"{quoted(target)}.{quoted(n)} AS t{i}" for i, n in enumerate(names)]
        update = [f"CAST({sets.get(n, f'{quoted(target)}.{quoted(n)}')} AS {kind}) AS u{i}" for i, (n, kind) in enumerate(zip(names, kinds, strict=True))]
        insert = [f"CAST({values.get(n, 'NULL')} AS {kind}) AS v{i}" for i, (n, kind) in enumerate(zip(names, kinds, strict=True))]
        joined = self.spark.sql(f"SELECT {', '.join(old + update + insert)}, {quoted(target)}.{row} AS at, coalesce({quoted(named)}.{seen}, FALSE) AS matched FROM {rows} FULL OUTER JOIN {tagged} ON {on}")
        path = f"{self.store.root}/{self.store.write(joined, {'indexes': []})}"
        made = self.spark.read.schema(joined.schema).parquet(path)
        both = made.where("matched and at is not null")
        self.must_be_empty(both.groupBy("at").count().where("count > 1"), "MERGE: a target row matches several source rows")
        take = lambda df, x: df.select(*[F.col(f"{x}{i}").alias(n) for i, n in enumerate(names)])
        fresh_segment = self.store.write(self.typed(t, take(both, "u").union(take(made.where("at is null"), "v"))), t)
        kept_segment = self.store.write(self.typed(t, take(made.where("not matched"), "t")), t)
        fresh, whole = self.store.read(t | {"segments": [fresh_segment]}), self.store.read(t | {"segments": [kept_segment, fresh_segment]})
        self.check(s.table, fresh, self.store.read(t | {"segments": [kept_segment]}))
        self.check_parents(s.table, whole)
        t["segments"] = [kept_segment, fresh_segment]
        self.sync()
        return f"{fresh.count()} rows merged from {named}"

    # --- triggers ---
    def do_create_trigger(self, s):
        if s.name in self.catalog["triggers"]:
            raise SqlError(f"trigger {s.name} exists already")
        self.table(s.table)
        for body in s.body:
            parse(body)
        self.catalog["triggers"][s.name] = {"when": s.when, "event": s.event, "table": s.table, "body": s.body}
        return f"trigger {s.name} created"

    def do_drop_trigger(self, s):
        if self.catalog["triggers"].pop(s.name, None) is None:
            raise SqlError(f"no such trigger: {s.name}")
        return f"trigger {s.name} dropped"

    def fire(self, when: str, event: str, table: str) -> None:
        """Once for each statement; an action that fails fails the statement."""
        for g in list(self.catalog["triggers"].values()):
            if (g["when"], g["event"], g["table"].lower()) == (when, event, table.lower()):
                if self.depth >= MAX_TRIGGERS:
                    raise SqlError("triggers are nested too deeply")
                self.depth += 1
                try:
                    for body in g["body"]:
                        self.perform(parse(body))
                finally:
                    self.depth -= 1

    def fired(self, event: str, table: str) -> str:
        self.fire("AFTER", event, table)
        return ""

    # --- control flow ---
    def do_while(self, s):
        rounds = 0
        while self.holds(s.condition):
            rounds += 1
            if rounds > MAX_LOOPS:
                raise SqlError(f"more than {MAX_LOOPS} rounds")
            self.loops += 1
            try:
                for one in s.body:
                    before = self.open
                    self.perform(one)
                    if not self.open and not before and self.depth == 0 and one.kind not in ("select", "explain", "benchmark", "while", "leave", "iterate"):
                        self.publish()
            except Iterate as x:
                if x.label and x.label != s.label:
                    raise
            except Leave as x:
                if x.label and x.label != s.label:
                    raise
                break
            finally:
                self.loops -= 1
        return f"{rounds} rounds"

    def do_leave(self, s):
        if not self.loops:
            raise SqlError("LEAVE outside a loop")
        raise Leave(s.label)

    def do_iterate(self, s):
        if not self.loops:
            raise SqlError("ITERATE outside a loop")
        raise Iterate(s.label)

    def holds(self, e: Expr) -> bool:
        known = literal(e)
        if known is not None:
            return bool(known[0])
        return bool(self.spark.sql(f"SELECT {self.emitter.truth(e, [], None)} AS v").first()[0])

    # --- transactions ---
    def do_begin(self, s):
        if self.open:
            raise SqlError("a transaction is open already")
        self.base, self.open = self.store.load()["version"], True
        self.before = copy.deepcopy(self.catalog)
        return "transaction begun"

    def do_commit(self, s):
        if not self.open:
            raise SqlError("no transaction is open")
        try:
            self.publish()
        finally:
            self.ended()
        return "committed"

    def do_rollback(self, s):
        if not self.open:
            raise SqlError("no transaction is open")
        self.ended()
        return "rolled back"

    def ended(self) -> None:
        self.open = False
        self.store.locks.release(self.id)
        self.catalog = self.store.load()
        self.sync()

    # --- users ---
    def do_create_user(self, s):
        if s.name.upper() in self.catalog["users"]:
            raise SqlError(f"user {s.name} exists already")
        self.catalog["users"][s.name.upper()] = verifier(s.password)
        return f"user {s.name} created"

    def do_alter_user(self, s):
        if s.name.upper() not in self.catalog["users"]:
            raise SqlError(f"no such user: {s.name}")
        self.catalog["users"][s.name.upper()] = verifier(s.password)
        return f"user {s.name} changed"

    def do_drop_user(self, s):
        if self.catalog["users"].pop(s.name.upper(), None) is None:
            raise SqlError(f"no such user: {s.name}")
        self.catalog["grants"] = [g for g in self.catalog["grants"] if g["user"] != s.name.upper()]
        return f"user {s.name} dropped"

    def do_grant(self, s):
        if s.user.upper() not in self.catalog["users"]:
            raise SqlError(f"no such user: {s.user}")
        for p in s.privileges:
            g = {"user": s.user.upper(), "privilege": p, "name": s.name}
            if g not in self.catalog["grants"]:
                self.catalog["grants"].append(g)
        return "granted"

    def do_revoke(self, s):
        self.catalog["grants"] = [g for g in self.catalog["grants"] if not (g["user"] == s.user.upper() and g["privilege"] in s.privileges and g["name"].lower() == s.name.lower())]
        return "revoked"

    def login(self, user: str, password: str) -> None:
        have = self.catalog["users"].get(user.upper())
        if not have or verifier(password, have["salt"]) != have:
            raise SqlError("wrong user or password")
        self.user = user.upper()

    def may(self, privilege: str, name: str) -> bool:
        if self.user == SUPERUSER or self.catalog["owners"].get(name.lower()) == self.user:
            return True
        return any(g["user"] == self.user and g["privilege"] == privilege and g["name"].lower() == name.lower() for g in self.catalog["grants"])

    def allowed(self, s: Statement) -> None:
        """Tables anywhere in the statement, subqueries included, and functions that it calls."""
        if self.user == SUPERUSER or self.depth:
            return
        needs = {"insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "merge": "UPDATE", "truncate": "DELETE", "load": "INSERT", "add_column": "ALTER", "drop_column": "ALTER", "rename_column": "ALTER", "rename_table": "ALTER", "create_index": "ALTER", "create_trigger": "ALTER", "drop_table": "DROP", "drop_view": "DROP", "drop_function": "DROP"}
        wanted = [(needs[s.kind], s.more.get("table") or s.more["name"])] if s.kind in needs else []
        if s.kind == "merge":
            wanted.append(("INSERT", s.table))
        ctes = {n.lower() for x in s.more.values() if isinstance(x, Query) for n, _ in x.ctes}
        wanted += [("SELECT", t) for t in tables_of(s.more) if t.lower() not in ctes]
        wanted += [("EXECUTE", self.catalog["functions"][f]["name"]) for f in calls_of(s.more) if f in self.catalog["functions"]]
        for privilege, name in wanted:
            if not self.may(privilege, name):
                raise SqlError(f"{self.user} has no {privilege} on {name}")
        if s.kind in ("create_user", "alter_user", "drop_user", "drop_index", "drop_trigger") or (s.kind in ("grant", "revoke") and self.catalog["owners"].get(s.name.lower()) != self.user):
            raise SqlError(f"{self.user} may not {s.kind.replace('_', ' ').upper()}")


class _Kept:
    """A DataFrame of a written segment, with the segment's name."""

    def __init__(self, df: DataFrame, segment: str):
        self._df, self.larkspur_segment = df, segment

    def __getattr__(self, name: str):
        return getattr(self._df, name)


def literal(e: Expr) -> tuple | None:
    """The value of a condition made of literals, without a Spark job; None if it is not one."""
    if e.kind == "literal":
        return (e.value,)
    if e.kind == "binary" and e.value in ("=", "!=", "<", "<=", ">", ">=", "AND", "OR"):
        sides = [literal(x) for x in e.args]
        if None in sides or any(x[0] is None for x in sides):
            return None
        a, b = sides[0][0], sides[1][0]
        return (reduce(lambda f, g: f or g, [e.value == "=" and a == b, e.value == "!=" and a != b, e.value == "<" and a < b, e.value == "<=" and a <= b, e.value == ">" and a > b, e.value == ">=" and a >= b, e.value == "AND" and bool(a and b), e.value == "OR" and bool(a or b)]),)
    return None
