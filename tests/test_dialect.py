"""The dialect on small tables: parsing, NULLs, statements, constraints, transactions, rights."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.functions.scalar import normal_pattern
from larkspur.plans.lexer import SqlError, statements, tokenize
from larkspur.plans.parser import parse
from larkspur.session import Session


@pytest.fixture(scope="module")
def db(spark):
    s = Session(spark)
    s.run("""
    CREATE TABLE t (id INT, name VARCHAR, value FLOAT, dept VARCHAR);
    INSERT INTO t VALUES (1,'Alice',3.14,'Engineering'),(2,'Bob',2.71,'Sales'),(3,'Carol',1.41,'Engineering'),(4,'Dave',9.81,'HR'),(5,'Eve',0.0,'Sales');
    CREATE TABLE ids (id INT); INSERT INTO ids VALUES (1),(3);
    CREATE TABLE tn (id INT, val INT); INSERT INTO tn VALUES (1,10),(2,NULL),(3,30);
    CREATE TABLE a (id INT); INSERT INTO a VALUES (1),(2),(2),(3);
    CREATE TABLE b (id INT); INSERT INTO b VALUES (2),(3),(4);
    CREATE TABLE p (name VARCHAR); INSERT INTO p VALUES ('a_b'),('a%b'),('axb'),('aXXb');
    CREATE TABLE scores (grp VARCHAR, score INT); INSERT INTO scores VALUES ('A',10),('A',10),('A',7),('B',5),('B',3)
    """)
    return s


def got(db, sql):
    return [tuple(r) for r in db.execute(sql).collect()]


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT id FROM t WHERE id = ANY (SELECT id FROM ids) ORDER BY id", [(1,), (3,)]),
        ("SELECT id FROM t WHERE id > ALL (SELECT id FROM ids) ORDER BY id", [(4,), (5,)]),
        ("SELECT id FROM t WHERE id NOT IN (SELECT id FROM ids) ORDER BY id", [(2,), (4,), (5,)]),
        ("SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.id = t.id) ORDER BY id", [(2,), (4,), (5,)]),
        ("SELECT id > ALL (SELECT val FROM tn) AS x FROM ids ORDER BY id", [(False,), (False,)]),
        ("SELECT 40 > ALL (SELECT val FROM tn) AS x, 5 < ANY (SELECT val FROM tn) AS y", [(None, True)]),
        ("SELECT COUNT(*) AS n FROM p WHERE name LIKE 'a_b'", [(3,)]),
        ("SELECT COUNT(*) AS n FROM p WHERE name LIKE 'a\\_b'", [(1,)]),
        ("SELECT COUNT(*) AS n FROM p WHERE name LIKE 'a\\%b'", [(1,)]),
        ("SELECT COUNT(*) AS n, COUNT(val) AS m, SUM(val) AS s, AVG(val) AS v FROM tn", [(3, 2, 40, 20.0)]),
        ("SELECT SUM(val) AS s FROM tn WHERE id > 9", [(None,)]),
        ("SELECT id FROM tn WHERE val != 10", [(3,)]),
        ("SELECT id FROM tn WHERE NOT (val = 10)", [(3,)]),
        ("SELECT id FROM tn WHERE val BETWEEN 1 AND 20", [(1,)]),
        ("SELECT 7 / 2 AS a, -7 / 2 AS b, 7 / 0 AS c, 7.0 / 2 AS d, -7 % 3 AS e, 7 % 0 AS f", [(3, -3, None, 3.5, -1, None)]),
        ("SELECT SUM(id) / COUNT(*) AS x FROM t", [(3,)]),
        ("SELECT COUNT(DISTINCT dept) AS n FROM t", [(3,)]),
        ("SELECT grp, score, RANK() OVER (PARTITION BY grp ORDER BY score DESC) AS r, DENSE_RANK() OVER (PARTITION BY grp ORDER BY score DESC) AS d FROM scores WHERE grp = 'A' ORDER BY score DESC", [("A", 10, 1, 1), ("A", 10, 1, 1), ("A", 7, 3, 2)]),
        ("SELECT id FROM a UNION SELECT id FROM b ORDER BY id", [(1,), (2,), (3,), (4,)]),
        ("SELECT COUNT(*) AS n FROM (SELECT id FROM a UNION ALL SELECT id FROM b) s", [(7,)]),
        ("SELECT id FROM a EXCEPT SELECT id FROM b EXCEPT SELECT id FROM ids", []),
        ("SELECT a.id, b.id FROM a FULL JOIN b ON a.id = b.id ORDER BY a.id, b.id", [(1, None), (2, 2), (2, 2), (3, 3), (None, 4)]),
        ("WITH x AS (SELECT id FROM t WHERE id < 3), y AS (SELECT id FROM x) SELECT COUNT(*) AS n FROM y", [(2,)]),
        ("SELECT id FROM tn ORDER BY val", [(1,), (3,), (2,)]),
        ("SELECT id FROM tn ORDER BY val DESC", [(2,), (3,), (1,)]),
        ("SELECT (SELECT MAX(val) FROM tn WHERE tn.id = t.id) AS m FROM t WHERE id < 4 ORDER BY id", [(10,), (None,), (30,)]),
        ("SELECT (SELECT name FROM t ORDER BY id) AS x", [("Alice",)]),
        ("SELECT LENGTH('né') AS a, TRIM(' \t x \n') AS b, SUBSTR('Alice', 0, 2) AS c, SUBSTR('Alice', -9, 2) AS d, SUBSTR('Alice', 2) AS e, SUBSTR('Alice', 2, -1) AS f", [(3, "x", "Al", "Al", "lice", "")]),
        ("SELECT ROUND(2.5) AS a, ROUND(-2.5) AS b, ROUND(2.345, 1) AS c, CEIL(1.2) AS d, FLOOR(-1.2) AS e, ABS(-3) AS f, NULLIF(1, 1) AS g, COALESCE(NULL, 2) AS h", [(3, -3, 2.3, 2, -2, 3, None, 2)]),
        ("SELECT CASE id WHEN 1 THEN 'one' END AS x, CASE WHEN id > 1 THEN 'more' ELSE 'less' END AS y FROM ids ORDER BY id", [("one", "less"), (None, "more")]),
        ("SELECT id FROM t ORDER BY value DESC LIMIT 2 OFFSET 1", [(1,), (2,)]),
        ("SELECT id FROM t WHERE id IN (1, NULL)", [(1,)]),
    ],
)
def test_select(db, sql, want):
    assert got(db, sql) == want


def test_distinct_doubles_and_strings_stay_apart(db):
    """Values that print alike are different keys; 'NULL' is not NULL; NULL keys do not join."""
    db.run("CREATE TABLE k (v FLOAT, s VARCHAR); INSERT INTO k VALUES (1.001,'NULL'),(1.004,NULL),(1.0,'a|')")
    assert got(db, "SELECT COUNT(*) AS n FROM (SELECT DISTINCT v FROM k) x") == [(3,)]
    assert got(db, "SELECT COUNT(*) AS n FROM k x JOIN k y ON x.s = y.s") == [(2,)]


@pytest.mark.parametrize("sql", ["SELECT", "SELECT id FROM", "SELECT a = b = c FROM t", "INSERT t VALUES (1)", "CREATE TABLE x (id BLOB)", "UPDATE t id = 1", "SELECT id FROM t WHERE", "GRANT FLY ON t TO u", "MERGE INTO t USING s ON a = b"])
def test_refused(sql):
    with pytest.raises(SqlError):
        parse(sql)


@pytest.mark.parametrize("sql", ["SELECT nope FROM t", "SELECT * FROM nope", "SELECT LOWER(name, 1) FROM t", "SELECT LAG(id) OVER (ORDER BY id) FROM t", "LEAVE", "COMMIT", "DROP TABLE nope"])
def test_errors(db, sql):
    with pytest.raises(Exception):
        out = db.execute(sql)
        out.collect()


def test_script_splitting():
    assert [s.split()[0] for s in statements("BEGIN; SELECT ';' FROM t -- a; b\n; WHILE 1 = 1 DO LEAVE; END WHILE; COMMIT;")] == ["BEGIN", "SELECT", "WHILE", "COMMIT"]
    assert tokenize("a /* b */ 1.5 'x\\'y'")[2].text == "x\\'y"


@given(st.text(alphabet="a%_\\b", max_size=8))
@settings(max_examples=100, deadline=None)
def test_patterns_are_always_valid(pattern):
    """Every backslash of a normal pattern escapes %, _ or itself."""
    made, i = normal_pattern(pattern), 0
    while i < len(made):
        if made[i] == "\\":
            assert made[i + 1] in "%_\\"
            i += 1
        i += 1


def test_constraints(spark):
    s = Session(spark)
    s.run("CREATE TABLE n (id INT PRIMARY KEY, name VARCHAR NOT NULL, v INT UNIQUE CHECK (v > 0)); INSERT INTO n VALUES (1,'a',1),(2,'b',NULL),(3,'c',NULL)")
    for sql in ["INSERT INTO n VALUES (1,'x',9)", "INSERT INTO n VALUES (4,NULL,9)", "INSERT INTO n VALUES (4,'x',1)", "INSERT INTO n VALUES (4,'x',-1)", "INSERT INTO n VALUES (7,'x',7),(7,'y',8)", "UPDATE n SET id = 1", "UPDATE n SET name = NULL WHERE id = 2", "UPDATE n SET v = 0 WHERE id = 1"]:
        with pytest.raises(SqlError):
            s.execute(sql)
    assert got(s, "SELECT COUNT(*) AS n FROM n") == [(3,)]
    s.execute("UPDATE n SET id = id + 1, v = id WHERE id = 3")
    assert got(s, "SELECT id, v FROM n WHERE name = 'c'") == [(4, 3)]


def test_foreign_keys(spark):
    s = Session(spark)
    s.run("""CREATE TABLE p (id INT PRIMARY KEY, v VARCHAR); CREATE TABLE c (id INT PRIMARY KEY, p INT REFERENCES p(id) ON DELETE CASCADE);
    CREATE TABLE g (c INT REFERENCES c(id) ON DELETE CASCADE); CREATE TABLE r (p INT REFERENCES p(id) ON DELETE RESTRICT);
    INSERT INTO p VALUES (1,'a'),(2,'b'),(3,'c'); INSERT INTO c VALUES (10,1),(11,2),(12,NULL); INSERT INTO g VALUES (10),(11); INSERT INTO r VALUES (2)""")
    with pytest.raises(SqlError):
        s.execute("INSERT INTO c VALUES (13, 99)")
    with pytest.raises(SqlError):
        s.execute("DELETE FROM p")
    assert got(s, "SELECT COUNT(*) AS n FROM g") == [(2,)]
    s.execute("DELETE FROM p WHERE id = 1")
    assert got(s, "SELECT id FROM c ORDER BY id") == [(11,), (12,)] and got(s, "SELECT c FROM g") == [(11,)]
    with pytest.raises(SqlError):
        s.execute("DROP TABLE p")


def test_transactions_and_restart(spark, tmp_path):
    s = Session(spark, str(tmp_path / "db"))
    s.run("CREATE TABLE x (id INT); INSERT INTO x VALUES (1)")
    before = s.execute("SELECT id FROM x")
    s.run("BEGIN; INSERT INTO x VALUES (2)")
    with pytest.raises(SqlError):
        s.execute("CREATE TABLE y (id INT)")
    other = Session(spark, str(tmp_path / "db"))
    with pytest.raises(SqlError, match="lock conflict"):
        other.execute("INSERT INTO x VALUES (3)")
    s.execute("ROLLBACK")
    s.run("BEGIN; INSERT INTO x VALUES (4); COMMIT")
    again = Session(spark, str(tmp_path / "db"))
    assert sorted(got(again, "SELECT id FROM x")) == [(1,), (4,)]
    assert [tuple(r) for r in before.collect()] == [(1,)]  # an earlier result does not change
    again.store.unread(again.catalog)
    assert sorted(got(again, "SELECT id FROM x")) == [(1,), (4,)]


def test_triggers_loops_and_limits(spark):
    s = Session(spark)
    s.run("CREATE TABLE o (id INT); CREATE TABLE log (id INT); CREATE TRIGGER t BEFORE DELETE ON o FOR EACH ROW EXECUTE 'INSERT INTO log VALUES (1)'; INSERT INTO o VALUES (1); DELETE FROM o WHERE id = 9")
    assert got(s, "SELECT COUNT(*) AS n FROM log") == [(1,)]
    s.run("DROP TRIGGER t; CREATE TRIGGER r AFTER INSERT ON o FOR EACH ROW EXECUTE 'INSERT INTO o VALUES (1)'")
    with pytest.raises(SqlError, match="too deeply"):
        s.execute("INSERT INTO o VALUES (5)")
    assert got(s, "SELECT COUNT(*) AS n FROM o") == [(1,)]
    s.run("DROP TRIGGER r; a: WHILE 1 = 1 DO INSERT INTO log VALUES (2); LEAVE a; END WHILE; WHILE (SELECT COUNT(*) FROM log) < 4 DO INSERT INTO log VALUES (3); END WHILE")
    assert got(s, "SELECT COUNT(*) AS n FROM log") == [(4,)]


def test_ddl(spark):
    s = Session(spark)
    s.run("CREATE TABLE t (id INT, name VARCHAR, score INT); CREATE INDEX i ON t(id) USING BTREE; INSERT INTO t VALUES (1,'a',2); ALTER TABLE t ADD COLUMN age INT; ALTER TABLE t DROP COLUMN score; ALTER TABLE t ADD COLUMN score INT; INSERT INTO t VALUES (2,'b',3,4)")
    assert sorted(got(s, "SELECT * FROM t")) == [(1, "a", None, None), (2, "b", 3, 4)]
    s.run("DROP INDEX i; TRUNCATE TABLE t; ALTER TABLE t RENAME TO u")
    assert got(s, "SELECT COUNT(*) AS n FROM u") == [(0,)]
    with pytest.raises(SqlError):
        s.execute("CREATE TABLE U (id INT)")
    s.run("CREATE VIEW v AS SELECT id FROM u; CREATE MATERIALIZED VIEW m AS SELECT id FROM u; INSERT INTO u VALUES (1,'x',1,1)")
    assert (got(s, "SELECT COUNT(*) AS n FROM v"), got(s, "SELECT COUNT(*) AS n FROM m")) == ([(1,)], [(0,)])
    s.run("DROP VIEW m; DROP VIEW v; CREATE FUNCTION add1(x INT) RETURNS INT AS 'x + 1'; CREATE TABLE nums (n INT); INSERT INTO nums VALUES (41)")
    assert got(s, "SELECT add1(n) AS x FROM nums") == [(42,)]
    with pytest.raises(SqlError):
        s.execute("CREATE FUNCTION add1(x INT) RETURNS INT AS 'x'")


def test_merge_errors_and_rights(spark):
    s = Session(spark)
    s.run("CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 1); CREATE TABLE s (id INT, v INT); INSERT INTO s VALUES (1, 5), (1, 6), (2, 7)")
    with pytest.raises(SqlError, match="several"):
        s.execute("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT VALUES (s.id, s.v)")
    s.execute("DELETE FROM s WHERE v = 6")
    s.execute("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = t.v + s.v WHEN NOT MATCHED THEN INSERT VALUES (s.id, s.v)")
    assert sorted(got(s, "SELECT * FROM t")) == [(1, 6), (2, 7)]
    s.run("CREATE USER u IDENTIFIED BY 'p'; GRANT SELECT, INSERT ON TABLE t TO u")
    with pytest.raises(SqlError):
        s.login("u", "q")
    s.login("u", "p")
    s.run("SELECT * FROM t; INSERT INTO t VALUES (3, 3); CREATE TABLE mine (id INT)")
    for sql in ["SELECT * FROM s", "SELECT * FROM t WHERE id IN (SELECT id FROM s)", "DELETE FROM t", "DROP TABLE t", "CREATE USER w IDENTIFIED BY 'x'"]:
        with pytest.raises(SqlError):
            s.execute(sql)


def test_plans(db):
    assert "Scan parquet" in db.execute("EXPLAIN SELECT id FROM t WHERE id > 3")
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in db.execute("EXPLAIN SELECT id FROM t WHERE id > 3")
    assert db.execute("EXPLAIN ANALYZE SELECT id FROM t").startswith("5 rows")
    assert db.execute("EXPLAIN FORMAT DOT SELECT id FROM t").startswith("digraph")
    assert "ratio" in db.execute("BENCHMARK SELECT id FROM t")


def test_load(db, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,bal\n1, Alice ,2.5\n2,NULL,\n3,null\n4,b,1.5,extra\n")
    db.run(f"CREATE TABLE csv (id INT, name VARCHAR, bal FLOAT); LOAD csv '{tmp_path}/x.csv'")
    assert sorted(got(db, "SELECT * FROM csv")) == [(1, "Alice", 2.5), (2, None, None), (3, None, None), (4, "b", 1.5)]
