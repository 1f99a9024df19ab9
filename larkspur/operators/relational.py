"""Relational operators on DataFrames where the dialect asks for more than one Spark call.

Everything is declarative; Catalyst picks join strategies from sizes it knows, so no side is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def scan(spark: SparkSession, folder: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet scan; Spark prunes columns and pushes filters into it."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def order(df: DataFrame, *keys: tuple[Column | str, bool]) -> DataFrame:
    """Sort by (key, ascending): NULLs last when ascending, first when descending."""
    return df.orderBy(*[sort_key(F.col(k) if isinstance(k, str) else k, up) for k, up in keys])


def sort_key(key: Column, ascending: bool) -> Column:
    return key.asc_nulls_last() if ascending else key.desc_nulls_first()


def top_k(df: DataFrame, keys: Sequence[tuple[Column | str, bool]], k: int) -> DataFrame:
    """Order and limit in one TakeOrderedAndProject."""
    return order(df, *keys).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[tuple[Column | str, bool]], k: int, name: str = "rn") -> DataFrame:
    """Spark plans the filter on the rank as a WindowGroupLimit, which cuts each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*[sort_key(F.col(x) if isinstance(x, str) else x, up) for x, up in keys])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def rank_without_order(kind: str) -> Column:
    """RANK and DENSE_RANK over nothing are 1 for every row."""
    if kind not in ("rank", "dense_rank"):
        raise ValueError(f"{kind} needs an order")
    return F.lit(1)


COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounds(other: DataFrame, column: str, name: str) -> DataFrame:
    """One row, a struct: what a comparison with all or any of a column's values needs."""
    c = F.col(f"`{column}`")
    return other.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(c).alias("known")).alias(name))


def quantified(df: DataFrame, x: Column, op: str, other: DataFrame, column: str, every: bool) -> DataFrame:
    """Rows of ``df`` where ``x op ANY/ALL (other.column)`` is true, uncorrelated.

    Equality against any is a semi join and inequality against all an anti join; the ordered comparisons need only
    the column's smallest and largest value, one row, whatever its size.
    """
    row, y = fresh("_row", df), fresh("_y", df)
    b = F.col(row)
    values = other.select(F.col(f"`{column}`").alias(y)).distinct()
    if op == "=" and not every:
        return df.join(values, x == F.col(y), "left_semi")
    if op == "!=" and every:
        kept = df.join(values, x == F.col(y), "left_anti")
        return kept.join(bounds(other, column, row), (b["n"] == 0) | ((b["n"] == b["known"]) & x.isNotNull()), "inner").drop(row)
    if every:
        holds = {"=": (x == b["lo"]) & (x == b["hi"]), "<": x < b["lo"], "<=": x <= b["lo"], ">": x > b["hi"], ">=": x >= b["hi"]}[op]
        condition = (b["n"] == 0) | ((b["n"] == b["known"]) & holds)
    else:
        holds = {"!=": (x != b["lo"]) | (x != b["hi"]), "<": x < b["hi"], "<=": x <= b["hi"], ">": x > b["lo"], ">=": x >= b["lo"]}[op]
        condition = (b["known"] > 0) & holds
    return df.join(bounds(other, column, row), condition, "inner").drop(row)


def set_operation(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION, UNION ALL, INTERSECT and EXCEPT by position; names come from the left."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{kind} needs as many columns on both sides: {len(left.columns)} and {len(right.columns)}")
    right = right.toDF(*left.columns)
    return {"UNION ALL": lambda: left.union(right), "UNION": lambda: left.union(right).distinct(), "INTERSECT": lambda: left.intersect(right), "EXCEPT": lambda: left.subtract(right)}[kind]()


def range_join(left: DataFrame, x: str, right: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """left.x BETWEEN right.lo AND right.hi, by an equality on cells instead of all pairs.

    Cells have levels, ``width`` times a power of two. An interval is listed at the level that fits it, in two cells at
    most however wide it is, and a point once for each level that some interval has (a few; their list is the one thing
    that comes to the driver), so the plan is a hash or merge join on level and cell.
    """
    level, cell = fresh("_level", left, right), fresh("_cell", left, right)
    a, b, p = (F.col(f"`{c}`") for c in (lo, hi, x))
    span = F.greatest((b - a) / width, F.lit(1.0))
    cells = right.where(a <= b).withColumn(level, F.ceil(F.log2(span)).cast("int"))
    levels = sorted(r[0] for r in cells.select(level).distinct().collect())
    at = lambda value: F.floor(value / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col(level))))
    listed = cells.withColumn(cell, F.explode(F.sequence(at(a), at(b))))
    points = left.withColumn(level, F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>"))).withColumn(cell, at(p))
    return points.join(listed, [level, cell]).where(p.between(a, b)).drop(level, cell)
