"""Operator 4, mixing sources to target weights along a time-varying curriculum.

Sources share all words by weight; a target above three times its source's size stops there and the excess goes
to the others by weight (water filling, in closed form over the table of sources). Each source has a weight
schedule over the training time, 1 + slope * (2 t - 1); its integral to t times the target is the cumulative
demand. A source's documents stand in the order of a hash of their doc_id and are read round and round until the
target is used up, the last one in part; the position of a document is the time at which the cumulative demand
reaches it (the inverse of the integral), and the mix is the documents sorted by range of position.

The table of sources, one row each, is ranked and filled in one task (some 50 bytes a source).

Cumulative sums never gather a source in one task: words are summed by source and hash bucket first (4096
buckets), the buckets' offsets are summed over that small table, and the last step runs within one bucket.

Defined results: null or empty texts have size 0 and are never taken; a null source is a source of its own, last in
order; null doc_ids sort first; repeated rows count and are taken as rows of their own; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._frames import documents
from larkspur.llm._store import Table

SPACES = "[ \\t-\\r]+"
SLOPES = (0.0, 0.5, -0.5)
MOST = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shares(sources: DataFrame) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size); as many rows as there are sources."""
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", (F.col("place") % 3 + 1).cast("long")).withColumn("most", F.col("source_size") * MOST)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    ranked = ranked.withColumn("turn", F.row_number().over(by_ratio))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("turn", "level"))).over(whole)["level"])
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    slope = F.element_at(F.array(*[F.lit(x) for x in SLOPES]), (F.col("place") % 3 + 1).cast("int"))
    return ranked.select("source", "source_size", target.alias("target"), slope.alias("slope"))


def time_of(share: Column, slope: Column) -> Column:
    """Inverse of t + slope * (t * t - t), the integral of the schedule."""
    rest = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(rest * rest + 4 * slope * share) - rest) / (2 * slope))


def assign(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """Adds source_size, target, slope, before, total and taken to ``rows`` (doc_id, source, size, place_key, bucket, ...).

    ``sized``: the columns source, bucket and size of the same rows.
    """
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    offsets = sums.withColumn("offset", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).drop("words")
    plan = offsets.alias("o").join(shares(sources).alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select(F.col("o.source").alias("of_source"), F.col("o.bucket").alias("of_bucket"), "offset", "source_size", "target", "slope")
    joined = rows.join(plan, rows.source.eqNullSafe(plan.of_source) & (rows.bucket == plan.of_bucket)).drop("of_source", "of_bucket")
    order = Window.partitionBy("source", "bucket").orderBy("place_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("before", F.col("offset") + F.sum("size").over(order) - F.col("size")).withColumn("total", F.floor(F.col("target") + 0.5))
    whole = F.when(F.col("source_size") > 0, F.expr("total div source_size")).otherwise(F.lit(0))
    joined = joined.withColumn("rounds", whole).withColumn("rest", F.col("total") - F.col("rounds") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return joined.withColumn("part", part).withColumn("taken", (F.col("rounds") * F.col("size") + F.col("part")).cast("long"))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the hash order and its bucket."""
    rows = rows.withColumn("place_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    return rows.withColumn("bucket", F.substring("place_key", 1, 3))


def position(nth: Column) -> Column:
    share = (nth * F.col("source_size") + F.col("before")).cast("double") / F.col("total")
    return F.abs(F.round(time_of(share, F.col("slope")), 9))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training order: the documents' columns, one row for each time a document is taken, sorted by position.

    A document whose last turn is cut holds its first words there, joined by one space.
    """
    names = docs.columns
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.size(words_of(F.col(f"`{text_col}`"))).cast("long").alias("size"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    inner = keyed(inner)
    placed = assign(inner, inner.select("source", "bucket", "size")).where("taken > 0")
    turns = placed.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("rounds").cast("int") - F.when(F.col("part") > 0, 0).otherwise(1))))
    turns = turns.withColumn("position", position(F.col("nth")))
    text = F.col("row")[f"c{names.index(text_col)}"]
    cut = (F.col("nth") == F.col("rounds")) & (F.col("part") < F.col("size"))
    shown = F.when(cut, F.array_join(F.slice(words_of(text), 1, F.col("part").cast("int")), " ")).otherwise(text)
    ordered = turns.withColumn("shown", shown).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "nth")
    return ordered.select(*[(F.col("shown") if c == text_col else F.col("row")[f"c{i}"]).alias(c) for i, c in enumerate(names)])


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = Table(keyed(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"))), "sizes").read()
    placed = assign(rows, rows).withColumn("position", F.when(F.col("taken") > 0, position(F.lit(0))))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS most FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY most / weight, place) AS turn,
             CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT level FROM l WHERE level <= most / weight ORDER BY turn LIMIT 1) * weight) AS target,
             CASE place % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE -0.5 END::DOUBLE AS slope FROM l),
o AS (SELECT d.*, source_size, target, slope, CAST(floor(target + 0.5) AS BIGINT) AS total,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN total // source_size ELSE 0 END AS rounds FROM o),
e AS (SELECT *, CAST(rounds * size + greatest(0, least(size, total - rounds * source_size - before)) AS BIGINT) AS taken, CAST(before AS DOUBLE) / total AS q FROM r)
SELECT doc_id, source, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN abs(round(CASE WHEN slope = 0 THEN q ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * q) - (1 - slope)) / (2 * slope) END, 9)) END AS position FROM e
"""
