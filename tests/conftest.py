import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = SparkSession.builder.master("local[4]").appName("larkspur-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse")).config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL


@pytest.fixture(scope="session")
def compare():
    """Rows of a query against DuckDB SQL on the same folder, whatever their order."""
    duckdb = pytest.importorskip("duckdb")

    def rows(data, names):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(str(r[i]) for i in order) for r in data)

    def check(df, sql, folder):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)

    return check
