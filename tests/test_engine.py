"""Constraints on fresh rows, one-join MERGE, cascades by key, commit conflicts, ANY and ALL by bounds, wide ranges."""

import pytest
from pyspark.sql import functions as F

from larkspur.catalog import Store
from larkspur.operators import relational as op
from larkspur.plans.lexer import SqlError
from larkspur.session import Session


def got(db, sql):
    return sorted((tuple(r) for r in db.execute(sql).collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def db(spark):
    s = Session(spark)
    s.run("""
    CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1,10),(2,NULL),(3,30),(NULL,40);
    CREATE TABLE ids (id INT); INSERT INTO ids VALUES (1),(3);
    CREATE TABLE none (id INT); CREATE TABLE nulls (id INT); INSERT INTO nulls VALUES (NULL),(2)
    """)
    return s


@pytest.mark.parametrize("every", ["ALL", "ANY"])
@pytest.mark.parametrize("op_", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("inner", ["ids", "none", "nulls"])
def test_any_and_all_have_three_values_and_no_pairs(db, op_, every, inner):
    """Projected, filtered and negated, against a plain evaluation."""
    compare = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op_]
    values = {"ids": [1, 3], "none": [], "nulls": [None, 2]}[inner]

    def truth(x):
        found = [None if x is None or v is None else compare(x, v) for v in values]
        if every == "ALL":
            return False if False in found else None if None in found else True
        return True if True in found else None if None in found else False

    rows = [1, 2, 3, None]
    test = f"id {op_} {every} (SELECT id FROM {inner})"
    shown = db.execute(f"SELECT id, {test} AS x FROM t")
    assert sorted(map(tuple, shown.collect()), key=str) == sorted(((x, truth(x)) for x in rows), key=str)
    kept = db.execute(f"SELECT id FROM t WHERE {test}")
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted((x for x in rows if truth(x)), key=str)
    assert got(db, f"SELECT id FROM t WHERE NOT ({test})") == sorted(((x,) for x in rows if truth(x) is False), key=str)
    if op_ not in ("=", "<>") or (op_ == "=") == (every == "ALL"):
        assert "NestedLoop" not in plan_of(kept) and "Cartesian" not in plan_of(kept)


def test_correlated_any(db):
    assert got(db, "SELECT id FROM t WHERE v >= ALL (SELECT x.v FROM t x WHERE x.id = t.id)") == [(1,), (3,), (None,)]


@pytest.mark.parametrize("table", ["_n", "_lo", "_row", "_y", "_cell"])
def test_operators_take_tables_with_any_column_names(spark, table):
    df = spark.createDataFrame([(1,), (5,)], f"{table} long")
    other = spark.createDataFrame([(2,), (3,)], f"{table} long")
    for o, every, want in ((">", True, [5]), ("=", False, []), ("!=", True, [1, 5]), ("<", False, [1])):
        assert sorted(r[0] for r in op.quantified(df, F.col(table), o, other, table, every).collect()) == want
    ranges = spark.createDataFrame([(0.0, 2.0)], "lo double, hi double")
    assert op.range_join(df, table, ranges, "lo", "hi", 1.0).count() == 1


def test_wide_ranges(spark):
    points = spark.range(0, 1000, 7).select(F.col("id").cast("double").alias("x"))
    ranges = [(0.0, 1e12), (5.0, 5.0), (10.0, 3.0), (-1e15, 6.5), (100.0, 228.0), (7.0, 14.0), (None, 4.0)]
    right = spark.createDataFrame(ranges, "lo double, hi double")
    got_ = sorted(tuple(r) for r in op.range_join(points, "x", right, "lo", "hi", 0.5).select("x", "lo", "hi").collect())
    assert got_ == sorted((float(x), lo, hi) for x in range(0, 1000, 7) for lo, hi in ranges if lo is not None and lo <= x <= hi)
    assert op.range_join(points, "x", right.where("false"), "lo", "hi", 0.5).count() == 0


def test_unique_of_fresh_rows_only_and_against_the_table(spark):
    s = Session(spark)
    s.run("CREATE TABLE u (id INT UNIQUE, v INT); INSERT INTO u VALUES (1, 1), (NULL, 2), (NULL, 3)")
    for bad in ("INSERT INTO u VALUES (5, 1), (5, 2)", "INSERT INTO u VALUES (1, 9)", "UPDATE u SET id = 1"):
        with pytest.raises(SqlError, match="UNIQUE"):
            s.execute(bad)
    s.execute("UPDATE u SET id = 1 WHERE id = 1")
    assert got(s, "SELECT COUNT(*) AS n FROM u") == [(3,)]


def test_merge_by_one_join(spark):
    s = Session(spark)
    s.run("CREATE TABLE a (id INT, v INT); INSERT INTO a VALUES (1, 1), (1, 1), (2, 2), (NULL, 3); CREATE TABLE b (id INT, v INT); INSERT INTO b VALUES (1, 10), (9, 90), (NULL, 5)")
    merge = "MERGE INTO a USING b ON a.id = b.id WHEN MATCHED THEN UPDATE SET v = a.v + b.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (b.id, b.v)"
    s.execute(merge)
    assert got(s, "SELECT id, v FROM a") == sorted([(1, 11), (1, 11), (2, 2), (9, 90), (None, 3), (None, 5)], key=str)
    s.execute("INSERT INTO b VALUES (2, 1), (2, 2)")
    with pytest.raises(SqlError, match="several"):
        s.execute(merge)
    assert got(s, "SELECT COUNT(*) AS n FROM a") == [(6,)]


def test_cascade_keeps_keys_that_another_row_still_has(spark):
    s = Session(spark)
    s.run("CREATE TABLE p (k INT UNIQUE, g INT); INSERT INTO p VALUES (1, 7), (2, 7), (3, 8); CREATE TABLE c (id INT PRIMARY KEY, k INT REFERENCES p(k) ON DELETE CASCADE); INSERT INTO c VALUES (1, 1), (2, 2), (3, 3), (4, NULL); CREATE TABLE d (c INT REFERENCES c(id) ON DELETE CASCADE); INSERT INTO d VALUES (1), (1), (3)")
    s.execute("DELETE FROM p WHERE k = 1")
    assert (got(s, "SELECT id FROM c"), got(s, "SELECT c FROM d")) == ([(2,), (3,), (4,)], [(3,)])
    s.run("CREATE TABLE e (k INT REFERENCES p(k) ON DELETE RESTRICT); INSERT INTO e VALUES (3)")
    with pytest.raises(SqlError, match="RESTRICT"):
        s.execute("DELETE FROM p")
    assert got(s, "SELECT COUNT(*) AS n FROM c") == [(3,)]


def test_only_one_of_two_drivers_commits(spark, tmp_path):
    """Two stores that share no locks, as two drivers: the second to publish a version has a conflict, nothing is lost."""
    root = str(tmp_path / "db")
    Session(spark, root).execute("CREATE TABLE t (id INT)")
    one, two = Store(spark, root), Store(spark, root)
    a, b = one.load(), two.load()
    version = a["version"]
    one.publish(a | {"owners": {"first": "1"}}, version)
    real = two.load
    two.load = lambda: b  # it looked before the other published
    with pytest.raises(SqlError, match="conflict"):
        two.publish(b | {"owners": {"second": "2"}}, version)
    two.load = real
    assert two.load()["owners"] == {"first": "1"} and two.load()["version"] == version + 1


def test_analyze_counts_where_rows_are(db):
    out = db.execute("EXPLAIN ANALYZE SELECT v, COUNT(*) AS n FROM t GROUP BY v")
    text = out if isinstance(out, str) else "\n".join(str(r[0]) for r in out.collect())
    assert text.startswith("4 rows") and "number of output rows" in text


def test_loops_rights_and_functions(spark, tmp_path):
    s = Session(spark, str(tmp_path / "db"))
    s.run("CREATE TABLE k (id INT); CREATE FUNCTION twice(x INT) RETURNS INT AS 'x * 2'")
    s.execute("again: WHILE (SELECT COUNT(*) FROM k) < 3 DO INSERT INTO k VALUES (1); ITERATE again; INSERT INTO k VALUES (2); END WHILE")
    assert got(s, "SELECT id FROM k") == [(1,)] * 3
    s.run("CREATE TABLE c (id INT CHECK (twice(id) < 10), v INT); INSERT INTO c VALUES (4, 1); UPDATE c SET v = twice(id)")
    assert got(s, "SELECT id, v FROM c") == [(4, 8)]
    with pytest.raises(SqlError, match="CHECK"):
        s.execute("INSERT INTO c VALUES (5, 1)")
    assert [r[0] for r in s.execute("SELECT id + 1, id FROM k ORDER BY 2 LIMIT 1").collect()] == [2]
    s.run("CREATE TABLE r (id INT)")
    assert got(s, "SELECT COUNT(*) AS n FROM r") == [(0,)]


def test_ungrouped_column_is_refused(db):
    with pytest.raises(Exception, match="(?i)group"):
        db.execute("SELECT id, COUNT(*) AS n FROM t GROUP BY v").collect()
