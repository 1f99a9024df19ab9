"""Operator 5, near-duplicate detection: bottom-k sketches of one hash function.

A document's set is its distinct shingles' 64-bit hashes; its sketch the SKETCH smallest, which is the whole set of a
short document. Documents of equal sets form a class, and the smallest stands for it.

- Overlaps. The inverted lists of the retained values say how many of its own a document shares with other classes.
  Two sets of n values or more and similarity t share t * n of them, so a set that is retained whole and shares
  fewer is linked with nothing, exactly. Of a larger set the sketch must share ``fewest(t)`` values, 58 of 128 at
  0.8: a linked pair has fewer in its union's sketch with odds below 1e-18.
- Candidates. For the sets that are left (a tenth of the corpus here) the full sets are listed, rarest value first:
  linked sets share one of their n - t * n + 1 rarest values, and the first that they share bounds their overlap by
  what comes after it in both. A list holds only such entries, and a pair is made only if the bound allows a link.
  This prefix filter loses nothing.
- Pairs. First each document meets the head of its longest list, the document with the fewest rarer values; then
  those outside a list's main component meet the list's 1 and 16 best heads; what is left meets the whole list, other
  components only. So a group of n near copies costs about n comparisons, not n squared. A pair is estimated in the
  sketch of its union, where fewer than ``fewest(t)`` shared values drop it (odds as above), then counted on the full
  sets.

Documents that share rare values with a whole group, are bounded by nothing and yet link with none of it, meet all of
that group in the last round: those pairs are needed to say that there is no link.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and are kept; a text shorter
than a shingle is one shingle of its own; a null doc_id has no component and is kept; repeated rows of one doc_id
are one document and share its result (if their texts differ, the links of any of them are the document's, counted
on one of them, the same in every run); extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._frames import documents, fresh, id_text, map_arrow
from larkspur.llm._store import Table, scratch
from larkspur.llm._text import U64, buffers, chained, mix, word_hashes, words
from larkspur.llm.components import components, extended

SKETCH = 128
#: Odds that a linked pair has fewer shared values in its sketches than is asked for.
ODDS = 1e-18
#: How many heads of a list those outside its main component meet in each round; the last round meets all.
ROUNDS = (1, 16, None)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fewest(percent: int, size: int = SKETCH) -> int:
    """The most values for which a sample of ``size`` from a union of similarity percent / 100 shares fewer with odds below ODDS."""
    p, total, k = percent / 100, 0.0, 0
    while k < size:
        total += math.comb(size, k) * p**k * (1 - p) ** (size - k)
        if total >= ODDS:
            break
        k += 1
    return k


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    lo, n = bounds[:-1], np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    top = np.append(0, np.cumsum(count))
    first = np.repeat(lo - top[:-1], count) + np.arange(top[-1])
    grams = chained(hashes, first, first + np.repeat(np.minimum(n, size), count))
    return [np.unique(grams[top[i] : top[i + 1]]) for i in range(len(n))]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(s) for s in rows])).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, needed, low): set size, two sums that stand for the set, the values that a linked set shares of those retained, and these."""
    few = fewest(percent)

    def step(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(1), size)
        n = np.array([len(s) for s in sets], np.int64)
        with np.errstate(over="ignore"):
            s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            s2 = np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
        whole = n * 100 <= SKETCH * percent  # such a set and all it may be linked with are retained whole
        needed = np.where(whole, -(-n * percent // 100), few)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(needed.astype(np.int32)), _lists([s[:SKETCH] for s in sets])], names=["doc_id", "n", "s1", "s2", "needed", "low"])

    return map_arrow(docs, step, "doc_id long, n long, s1 long, s2 long, needed int, low array<long>")


def overlapping(made: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2) of the rows that share enough retained values with other classes."""
    rows = made.select("doc_id", "n", "s1", "s2", "needed", F.explode("low").alias("value"))
    shared = Table(rows.groupBy("value").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("value"), "shared-values")
    per_row = rows.join(shared.read(), "value", "left_semi").groupBy("doc_id", "n", "s1", "s2", "needed").agg(F.count(F.lit(1)).alias("have"))
    return per_row.where("have >= needed").select("doc_id", "n", "s1", "s2")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, grams): the sorted hashes as bytes, one row for each document."""

    def step(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(1), size)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "n", "grams"])

    rows = map_arrow(docs, step, "doc long, n long, grams binary")
    return rows.groupBy("doc").agg(F.max(F.struct("n", "grams")).alias("best")).select("doc", "best.n", "best.grams")


def rarest_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(value, doc, n, rest): each set's rarest values that others of ``sets`` have too, and how many come from there on.

    Order: how many sets have the value, then the value. Kept are the n - t * n + 1 first.
    """

    def step(batch: pa.RecordBatch):
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
        size = np.array([len(x) for x in grams])
        values = np.concatenate(grams) if len(grams) else np.zeros(0, np.uint64)
        repeat = lambda c: pa.array(np.repeat(c.to_numpy(zero_copy_only=False), size))
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), repeat(batch.column(0)), repeat(batch.column(1))], names=["value", "doc", "n"])

    rows = map_arrow(sets, step, "value long, doc long, n long")
    often = Table(rows.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "shared-shingles")
    of = Window.partitionBy("doc")
    ranked = rows.join(often.read(), "value").withColumn("after", F.row_number().over(of.orderBy(F.desc("often"), F.desc("value"))))
    kept = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.where(F.col("n") - F.col("after") < kept).select("value", "doc", "n", F.col("after").cast("long").alias("rest"))


def may_link(percent: int, x: str, y: str) -> Column:
    """Whether sets of nx and ny values that share restx and resty of them at most can reach the similarity."""
    least = F.least(f"rest{x}", f"rest{y}")
    return (100 + percent) * least >= percent * (F.col(f"n{x}") + F.col(f"n{y}"))


def counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are linked, by the estimate in the union's sketch and then on the full sets."""
    joined = pairs.join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("doc").alias("b"), F.col("grams").alias("grams_b")), "b").select("a", "b", "grams_a", "grams_b")
    few = fewest(percent)

    def step(batch: pa.RecordBatch):
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            union = np.sort(np.concatenate((x[:SKETCH], y[:SKETCH])))
            twice = union[1:] == union[:-1]
            if len(union) - twice.sum() >= SKETCH:  # at the place of the SKETCH-th value of the union
                last = np.flatnonzero(np.append(True, ~twice))[SKETCH - 1]
                if twice[: last + 1].sum() < few:
                    continue
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = 100 * same >= percent * (len(x) + len(y) - same)
        return pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return map_arrow(joined, step, "a long, b long")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def first_pairs(index: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Each document with the head of its longest list."""
    met = index.select("value", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("restx")).join(heads, "value").where("x <> y").where(may_link(percent, "x", "y"))
    return _pairs(met.groupBy("x").agg(F.max_by("y", F.struct("length", "value")).alias("y")))


def crossing(index: DataFrame, merged: DataFrame) -> DataFrame:
    """(value, doc, n, rest, component, main) of the lists that documents of several components are in."""
    labelled = Table(index.join(merged.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "labelled")
    parts = labelled.read().groupBy("value", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = Table(parts.groupBy("value").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("value", "main"), "mixed")
    return labelled.read().join(mixed.read(), "value")


def across(rows: DataFrame, heads: int | None, percent: int) -> DataFrame:
    """Pairs of a list's documents outside its main component with ``heads`` of the list (null: all) of other components."""
    side = lambda x: [F.col("doc").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("rest").alias(f"rest{x}")]
    outside = rows.where("component <> main").select("value", *side("x"))
    others = rows
    if heads:
        best = Window.partitionBy("value").orderBy((F.col("component") == F.col("main")).desc(), F.desc("rest"), "doc")
        others = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= heads)
    return _pairs(outside.join(others.select("value", *side("y")), "value").where((F.col("cx") != F.col("cy")) & may_link(percent, "x", "y")))


def near_links(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[Table, Table]:
    """All documents with their class (doc_id, n, rep), and the components of the classes (node, component)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    with scratch():
        return _near_links(id_text(docs, id_col, text_col), size, percent)


def _near_links(source: DataFrame, size: int, percent: int) -> tuple[Table, Table]:
    made = Table(sketches(source, size, percent), "sketches")
    sets = made.read().where("doc_id is not null and n > 0")
    classes = Table(sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    members = Table(made.read().select("doc_id", "n", "s1", "s2").join(classes.read(), ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "members")
    wanted = Table(overlapping(sets).join(classes.read(), ["n", "s1", "s2"]).where("doc_id = rep").select("doc_id").distinct(), "wanted")
    made.drop()
    grams = Table(full_sets(source.join(wanted.read(), "doc_id", "left_semi"), size), "sets")
    lists = Table(rarest_lists(grams.read(), percent), "lists")
    index = lists.read()
    by_head = index.groupBy("value").agg(F.max(F.struct("rest", -F.col("doc"), "n")).alias("head"), F.count(F.lit(1)).alias("length")).where("length > 1")
    heads = Table(by_head.select("value", (-F.col("head.col2")).alias("y"), F.col("head.n").alias("ny"), F.col("head.rest").alias("resty"), "length"), "heads")
    found = [Table(counted(Table(first_pairs(index, heads.read(), percent), "pairs").read(), grams.read(), percent), "links")]
    out = components(found[0].read())  # later rounds only merge the components that they link
    for many in ROUNDS:
        rows = Table(crossing(index, out.read()), "crossing")
        found.append(Table(counted(Table(across(rows.read(), many, percent), "pairs").read(), grams.read(), percent), "links"))
        rows.drop()
        if found[-1].read().limit(1).count():
            out = extended(out, found[-1].read())
    return members.keep(), out.keep()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    members, merged = near_links(docs, shingle, percent, id_col, text_col)
    joined = members.read().join(merged.read(), F.col("rep") == F.col("node"), "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that a smaller doc_id's group has; null doc_ids stay."""
    gone = fresh("near_of", docs.columns)
    out = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")


def op5_bottom_k_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
