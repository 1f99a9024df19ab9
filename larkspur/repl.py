"""The shell: ``python -m larkspur.repl [--db FOLDER] [--file SCRIPT] [--generate N] [SCRIPT]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.emit import AGGREGATES, ARITY, WINDOWS
from larkspur.plans.lexer import statements
from larkspur.session import Session
from larkspur.sources import synthetic
from larkspur.sources.dump import dump, table_text

HELP = """.help .functions .tables .schema TABLE .principal .generate N .save FILE .source FILE .plan SELECT .triggers .benchmark .quit"""
SUITE = (
    "SELECT * FROM employees WHERE salary > 100000",
    "SELECT dept, COUNT(*) AS n, AVG(salary) AS mean FROM employees GROUP BY dept",
    "SELECT e.name, d.location FROM employees e JOIN departments d ON e.dept = d.dept_name WHERE e.salary > 80000",
    "SELECT name, salary FROM employees ORDER BY salary DESC LIMIT 10",
)


def generate(session: Session, n: int) -> str:
    """The demo tables, written into the database."""
    kinds = {"bigint": "INT", "double": "FLOAT", "string": "VARCHAR"}
    for name, df in (("employees", synthetic.employees(session.spark, n)), ("departments", synthetic.departments(session.spark)), ("orders", synthetic.orders(session.spark, n))):
        if name in session.catalog["tables"]:
            session.execute(f"DROP TABLE {name}")
        session.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[k]}' for c, k in df.dtypes)})")
        df.createOrReplaceTempView(f"_made_{name}")
        session.execute(f"INSERT INTO {name} SELECT * FROM _made_{name}")
    return f"{n} employees, 10 departments, {n // 2} orders"


def command(session: Session, line: str) -> str:
    """One dot command."""
    name, _, rest = line.strip().partition(" ")
    rest = rest.strip().rstrip(";")
    catalog = session.catalog
    if name == ".help":
        return HELP
    if name == ".functions":
        return "\n".join(sorted([*ARITY, *AGGREGATES, *WINDOWS, *(f["name"] for f in catalog["functions"].values())]))
    if name == ".tables":
        return "\n".join([*catalog["tables"], *(v for v, x in catalog["views"].items() if not x["materialized"])])
    if name == ".schema":
        return "\n".join(f"{c['name']} {c['type']}" + " NOT NULL" * c["not_null"] + " UNIQUE" * c["unique"] for c in session.table(rest)["columns"])
    if name == ".principal":
        return session.user
    if name == ".generate":
        return generate(session, int(rest or 10_000))
    if name == ".save":
        dump(session, rest)
        return f"saved to {rest}"
    if name == ".source":
        return source(session, rest)
    if name == ".plan":
        return session.execute(f"EXPLAIN {rest}")
    if name == ".triggers":
        return "\n".join(f"{n}: {g['when']} {g['event']} ON {g['table']}" for n, g in catalog["triggers"].items())
    if name == ".benchmark":
        if "employees" not in catalog["tables"]:
            generate(session, 10_000)
        return "\n".join(f"{q}\n  {session.execute('BENCHMARK ' + q)}" for q in SUITE)
    return f"no such command: {name}\n{HELP}"


def answer(session: Session, text: str) -> str:
    """What the shell prints for a command or statement."""
    if text.lstrip().startswith("."):
        return command(session, text)
    out = session.execute(text)
    return table_text(out) if isinstance(out, DataFrame) else out


def source(session: Session, path: str) -> str:
    """A script: dot commands on lines of their own, statements up to their semicolons; the first error ends it."""
    out, held = [], ""
    with open(path, encoding="utf-8") as f:
        for line in f:
            if not held.strip() and line.lstrip().startswith("."):
                out.append(command(session, line))
                continue
            held += line
            if line.rstrip().endswith(";"):
                out += [answer(session, s) for s in statements(held)]
                held = ""
    if held.strip():
        out += [answer(session, s) for s in statements(held)]
    return "\n".join(out)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("script", nargs="?")
    p.add_argument("--file")
    p.add_argument("--generate", type=int)
    p.add_argument("--db")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("larkspur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session = Session(spark, a.db)
    if a.generate:
        print(generate(session, a.generate))
    for path in (a.file, a.script):
        if path:
            try:
                print(source(session, path))
            except Exception as e:
                print(f"Error: {e}")
                return 1
            return 0
    held = ""
    for line in sys.stdin:
        if not held.strip() and line.strip() in (".quit", ".exit"):
            break
        held += line
        if held.lstrip().startswith(".") or line.rstrip().endswith(";"):
            try:
                print("\n".join(answer(session, s) for s in ([held] if held.lstrip().startswith(".") else statements(held))))
            except Exception as e:
                print(f"Error: {e}")
            held = ""
    return 0


if __name__ == "__main__":
    sys.exit(main())
