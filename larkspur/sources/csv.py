"""CSV as LOAD reads it: a header line, commas, no quoting, blanks trimmed, NULL and empty cells are NULL.

Short rows are padded with NULL, extra cells are cut off, and cells are cast to the declared types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Rows typed by (name, type) pairs. Lines are read as text, so the file splits over tasks."""
    reader = spark.read.option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
    raw = reader.schema(", ".join(f"`c{i}` string" for i in range(len(columns)))).csv(path)
    cell = lambda i: F.when(F.lower(F.col(f"c{i}")).isin("null", ""), None).otherwise(F.col(f"c{i}"))
    return raw.select(*[cell(i).cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])
