"""The shell, the server, the dump and the stream sink."""

import pytest

from larkspur import repl
from larkspur.plans.lexer import SqlError
from larkspur.server import Client, Server
from larkspur.session import Session
from larkspur.sources.dump import table_text
from larkspur.streaming import append_stream


def test_shell(spark, tmp_path):
    s = Session(spark)
    script = tmp_path / "s.sql"
    script.write_text(".generate 100\nSELECT COUNT(*) AS n\n FROM employees;\nSELECT dept, COUNT(*) AS n FROM employees -- note\nGROUP BY dept; SELECT ';' AS x FROM departments LIMIT 1;\n")
    out = repl.source(s, str(script))
    assert "100 employees" in out and "100" in out.splitlines()[3] and ";" in out.splitlines()[-1]
    assert "employees" in repl.command(s, ".tables") and "salary bigint" in repl.command(s, ".schema employees")
    assert "SUBSTR" in repl.command(s, ".functions") and repl.command(s, ".principal") == "ADMIN" and "no such" in repl.command(s, ".nope")
    assert repl.command(s, f".save {tmp_path}/dump.txt") and "departments" in (tmp_path / "dump.txt").read_text()
    assert table_text(s.execute("SELECT id FROM employees ORDER BY id"), 5).endswith("...")
    again = Session(spark)
    repl.generate(again, 100)
    q = "SELECT SUM(salary) AS a, SUM(age) AS b FROM employees"
    assert s.execute(q).collect() == again.execute(q).collect()


def test_server(spark, tmp_path):
    root = str(tmp_path / "db")
    Session(spark, root).run("CREATE TABLE t (id INT); INSERT INTO t VALUES (1); CREATE USER u IDENTIFIED BY 'p'; GRANT SELECT ON TABLE t TO u")
    server = Server(spark, root)
    port = server.start()
    c = Client(port)
    with pytest.raises(SqlError, match="log in"):
        c.execute("SELECT * FROM t")
    c.login("u", "p")
    assert c.execute("SELECT id FROM t") == {"columns": ["id"], "rows": [[1]], "more": False}
    with pytest.raises(SqlError, match="no INSERT"):
        c.execute("INSERT INTO t VALUES (2)")
    d = Client(port)
    for _ in range(3):
        with pytest.raises(SqlError):
            d.login("u", "x")
    with pytest.raises(SqlError, match="locked"):
        d.login("u", "p")
    c.close()
    d.close()
    server.shutdown()


def test_server_sends_all_rows_and_takes_its_limits(spark, tmp_path):
    """Results longer than a frame come whole; nonces and lock-outs last as long as the server is told."""
    root = str(tmp_path / "db")
    Session(spark, root).run("CREATE TABLE t (id INT); CREATE USER u IDENTIFIED BY 'p'; GRANT SELECT ON TABLE t TO u")
    server = Server(spark, root, open=True, frame=3)
    c = Client(server.start())
    c.execute("INSERT INTO t VALUES " + ", ".join(f"({k})" for k in range(10)))
    got = c.execute("SELECT id FROM t ORDER BY id")
    assert [r[0] for r in got["rows"]] == list(range(10)) and got["more"] is False
    assert c.execute("SELECT id FROM t WHERE id > 99") == {"columns": ["id"], "rows": [], "more": False}
    with pytest.raises(SqlError):
        c.execute("SELECT nothing FROM t")
    assert c.execute("SELECT COUNT(*) AS n FROM t")["rows"] == [[10]]
    c.close()
    server.shutdown()
    late = Server(spark, root, nonce_s=0, failures=1, locked_s=0)
    d = Client(late.start())
    with pytest.raises(SqlError, match="wrong"):
        d.login("u", "p")
    with pytest.raises(SqlError, match="wrong"):  # no longer locked out
        d.login("u", "p")
    d.close()
    late.shutdown()


def test_stream(spark, tmp_path):
    s = Session(spark)
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR)")
    for k in range(2):
        spark.range(k * 10, k * 10 + 5).selectExpr("id", "concat('n', id) AS name").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in"))
        append_stream(s, stream, "t", str(tmp_path / "ck")).awaitTermination()
    assert s.execute("SELECT COUNT(*) AS n FROM t").first().n == 10
