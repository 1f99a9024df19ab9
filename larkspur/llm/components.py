"""Connected components of a link table, by large-star and small-star rounds of joins.

The links stay distributed; each round is written to the shared folder, and only two numbers a round (count and
checksum) come to the driver to see whether the table still changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._store import Table, scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), each once, u > v for small stars; any direction for large ones."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> Table:
    """(node, component): the smallest node reachable; only nodes that have a link, nulls and loops left out."""
    with scratch():
        return _components(links, a, b).keep()


def _components(links: DataFrame, a: str, b: str) -> Table:
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = Table(start, "links"), None
    mark = lambda t: tuple(t.read().agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        before, now = now, Table(_star(_star(now.read(), True), False), "links")
        before.drop()
        last, seen = seen, mark(now)
        if seen == last:
            break
    table = now.read()
    out = Table(table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    now.drop()
    return out


def extended(known: Table, links: DataFrame, a: str = "a", b: str = "b") -> Table:
    """The components of ``known`` after more links: only the components that these touch are worked on."""
    with scratch():
        own = known.read()
        side = lambda c: own.select(F.col("node").alias(f"node_{c}"), F.col("component").alias(f"own_{c}"))
        between = links.join(side(a), F.col(a) == F.col(f"node_{a}"), "left").join(side(b), F.col(b) == F.col(f"node_{b}"), "left")
        between = between.select(F.coalesce(f"own_{a}", a).alias("a"), F.coalesce(f"own_{b}", b).alias("b")).distinct()
        merged = components(between).read()
        into = merged.select(F.col("node").alias("from"), F.col("component").alias("to"))
        moved = own.join(into, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
        return Table(moved.unionByName(merged).distinct(), "components").keep()
