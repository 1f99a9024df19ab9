"""Operator 1, substring dedup: a compacted De Bruijn graph of word windows.

The 50-word windows are the edges of a De Bruijn graph over words. One pass cuts every document into
super-k-mers: runs of consecutive windows that share one minimizer, about one row for 22 words. Only
minimizers seen in two documents or more can hold repeated edges, so the rest is dropped by a semi join.
Equal runs are one node, told by the minimizer's and the run's hash; nodes whose every occurrence has the same
successor, which in turn has that one predecessor, compact into a path by a join on the links, and a path needs one
row for each occurrence. Where runs of one minimizer differ, the graph branches: there, and only there, the exact
windows of one representative of each run are compared.

Source coordinates verify: one pass reads the documents that the paths and branches were first seen in. It gives
each path the BLAKE2 digest of its words, and an occurrence is cut only if the words at its own coordinates have the
same digest; and it gives each window at a branch two independent 62-bit hashes.

Hot keys: runs, nodes and windows are aggregated map-side, what they are joined with is a written table with one row
for each key, and those joins are inner or semi joins of plain exchanges, which adaptive execution splits.

Defined results: null text has no words; a document of fewer than 50 words keeps all; a null doc_id is neither
a source nor changed; repeated rows of one doc_id (equal text) each get the same result, as the same doc_id is
not smaller. Hashes of words chain 8-byte pieces through a finalizer and hashes of windows are polynomials over a
prime field, so repetitive texts do not cancel in them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._frames import documents, fresh, id_text, map_arrow
from larkspur.llm._store import Table, scratch
from larkspur.llm._text import buffers, covered, segments, wide_hashes, word_hashes, words

WINDOW = 50
GRAM = 8


def _word_hashes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    starts, ends, bounds = words(data, offsets)
    return word_hashes(data, starts, ends), bounds, starts, ends


def super_kmers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(mh, sh, doc, pos, nw): minimizer, hash of the run, document, first window, number of windows."""

    def step(batch: pa.RecordBatch):
        hashes, bounds, _, _ = _word_hashes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for mh, sh, doc, pos, nw in segments(hashes, bounds, window, gram):
            yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(ids[doc].astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(nw.astype(np.int32))], names=["mh", "sh", "doc", "pos", "nw"])

    return map_arrow(docs.where("doc_id is not null"), step, "mh long, sh long, doc long, pos int, nw int")


def compact(runs: DataFrame) -> DataFrame:
    """Nodes of the graph: (mh, sh, doc0, pos0, doc1, nw, next_mh, next_sh, prev_mh, prev_sh), first and last document."""
    by_doc = Window.partitionBy("doc").orderBy("pos", "sh")
    ahead = F.lead("pos").over(by_doc) == F.col("pos") + F.col("nw")
    behind = F.lag("pos").over(by_doc) + F.lag("nw").over(by_doc) == F.col("pos")
    linked = runs.select("mh", "sh", "doc", "pos", "nw", *[F.when(ahead, F.lead(c).over(by_doc)).alias(f"next_{c}") for c in ("mh", "sh")], *[F.when(behind, F.lag(c).over(by_doc)).alias(f"prev_{c}") for c in ("mh", "sh")])
    only = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    nodes = linked.groupBy("mh", "sh").agg(F.min(F.struct("doc", "pos")).alias("rep"), F.max("doc").alias("doc1"), F.max("nw").alias("nw"), *[only(c) for c in ("next_mh", "next_sh", "prev_mh", "prev_sh")])
    return nodes.select("mh", "sh", F.col("rep.doc").alias("doc0"), F.col("rep.pos").alias("pos0"), "doc1", "nw", "next_mh", "next_sh", "prev_mh", "prev_sh")


def paths(nodes: DataFrame) -> DataFrame:
    """Join each node with its only successor; runs of such links, in the first document's coordinates, are paths."""
    ahead = nodes.where("next_mh is not null and next_sh is not null").select(F.col("mh").alias("from_mh"), F.col("sh").alias("from_sh"), F.col("next_mh").alias("mh"), F.col("next_sh").alias("sh"))
    ahead = ahead.withColumnsRenamed({"mh": "to_mh", "sh": "to_sh"})
    joined = nodes.join(ahead, (nodes.mh == ahead.to_mh) & (nodes.sh == ahead.to_sh) & (nodes.prev_mh == ahead.from_mh) & (nodes.prev_sh == ahead.from_sh), "left")
    order = Window.partitionBy("doc0").orderBy("pos0", "sh")
    follows = F.col("from_sh").isNotNull() & (F.lag("sh").over(order) == F.col("from_sh")) & (F.lag("mh").over(order) == F.col("from_mh"))
    chained = joined.select("mh", "sh", "doc0", "pos0", "nw", "doc1", F.when(follows, 0).otherwise(1).alias("head"))
    chained = chained.withColumn("path", F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("doc0", "path").agg(F.min(F.struct("pos0", "sh", "mh")).alias("first"), F.sum("nw").cast("int").alias("windows"), F.max("doc1").alias("doc1")).select(F.col("first.mh").alias("mh"), F.col("first.sh").alias("sh"), "doc0", F.col("first.pos0").alias("pos0"), "windows", "doc1")


def read_sources(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(mh, sh, doc, windows, digest, first, second) of spans (mh, sh, doc0, pos0, windows, branch), read at their coordinates.

    A path (not ``branch``) gets the digest of its words, a run at a branch two hashes of each of its windows.
    """
    wanted = spans.groupBy(F.col("doc0").alias("rep_doc")).agg(F.collect_list(F.struct("pos0", "windows", "mh", "sh", "branch")).alias("at"))
    joined = docs.dropDuplicates(["doc_id"]).join(wanted, F.col("doc_id") == F.col("rep_doc"))

    def step(batch: pa.RecordBatch):
        hashes, bounds, starts, ends = _word_hashes(batch.column(1))
        raw = buffers(batch.column(1))[0].tobytes()
        lists = batch.column(2)
        at = lists.flatten()
        pos, count, mh, sh, branch = (at.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        first = bounds[doc] + pos
        fits = (pos >= 0) & (first + count + window - 1 <= bounds[doc + 1])
        order = np.flatnonzero(fits)[np.argsort(first[fits], kind="stable")]
        first, count, mh, sh, doc, branch = first[order], count[order].astype(np.int64), mh[order], sh[order], doc[order], branch[order].astype(bool)
        digest = [None if b else digest_of([raw[x:y] for x, y in zip(starts[p : p + k].tolist(), ends[p : p + k].tolist(), strict=True)]) for b, p, k in zip(branch, first.tolist(), (count + window - 1).tolist(), strict=True)]
        size = np.where(branch, count, 0)
        offsets = np.append(0, np.cumsum(size))
        both = wide_hashes(hashes, np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1]), window)
        edges = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x.view(np.int64))) for x in both]
        ids = batch.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(mh), pa.array(sh), pa.array(ids), pa.array(count.astype(np.int32)), pa.array(digest, pa.binary()), *edges], names=["mh", "sh", "doc", "windows", "digest", "first", "second"])

    return map_arrow(joined.select("doc_id", "text", "at"), step, "mh long, sh long, doc long, windows int, digest binary, first array<long>, second array<long>")


def digest_of(words_of_span: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words_of_span), digest_size=16).digest()


def branched(read: DataFrame) -> DataFrame:
    """Of the runs' windows, those that also stand in a smaller document: (mh, sh, rep, off, windows)."""
    edges = read.where("digest is null").select("mh", "sh", "doc", F.posexplode(F.arrays_zip("first", "second")).alias("off", "edge")).select("mh", "sh", "doc", "off", "edge.first", "edge.second")
    least = Table(edges.groupBy("first", "second").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("first", "second", "lo"), "edges")
    hits = edges.join(least.read(), ["first", "second"]).where("doc > lo")
    of = Window.partitionBy("mh", "sh", "doc").orderBy("off")
    hits = hits.withColumn("island", F.col("off") - F.row_number().over(of))
    return hits.groupBy("mh", "sh", F.col("doc").alias("rep"), "island").agg(F.min("off").alias("off"), F.count(F.lit(1)).cast("int").alias("windows")).drop("island")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> Table:
    """Runs of windows that also start in a smaller document, as a written table (doc, pos, windows, digest or null)."""
    with scratch():
        return _repeated_spans(id_text(docs, id_col, text_col), window, gram).keep()


def _repeated_spans(source: DataFrame, window: int, gram: int) -> Table:
    runs = Table(super_kmers(source, window, gram), "runs")
    shared = Table(runs.read().groupBy("mh").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("mh"), "shared")
    kept = Table(runs.read().join(shared.read(), "mh", "left_semi"), "repeated")
    runs.drop()
    nodes = Table(compact(kept.read()), "nodes")
    graph = nodes.read()
    split = Table(graph.groupBy("mh").agg(F.count(F.lit(1)).alias("n"), F.min("doc0").alias("lo"), F.max("doc0").alias("hi")).where("n > 1 and lo < hi").select("mh"), "split")
    heads = paths(graph).where("doc0 < doc1").select("mh", "sh", "doc0", "pos0", "windows", F.lit(False).alias("branch"))
    runs_at = graph.join(split.read(), "mh", "left_semi").select("mh", "sh", "doc0", "pos0", F.col("nw").alias("windows"), F.lit(True).alias("branch"))
    read = Table(read_sources(source.where("doc_id is not null"), heads.unionByName(runs_at), window), "sources")
    occurrences = kept.read()
    verified = read.read().where("digest is not null").select("mh", "sh", F.col("doc").alias("doc0"), "windows", "digest")
    whole = occurrences.select("mh", "sh", "doc", "pos").join(verified, ["mh", "sh"]).where("doc > doc0").select("doc", "pos", "windows", "digest")
    partly = Table(branched(read.read()), "branched").read()
    partly = occurrences.select("mh", "sh", "doc", "pos").join(partly, ["mh", "sh"]).where("doc = rep").select("doc", (F.col("pos") + F.col("off")).alias("pos"), "windows", F.lit(None).cast("binary").alias("digest"))
    return Table(whole.unionByName(partly), "spans")


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """The documents with an array column of their spans (null: none), and this column's name."""
    at, key = (fresh(x, docs.columns) for x in ("span_at", "span_doc"))
    lists = spans.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("pos", "windows", "digest")).alias(at))
    return docs.join(lists, F.col(f"`{id_col}`").cast("long") == F.col(key), "left").drop(key), at


def repeats_of(spans, row: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint word ranges of a row's spans, without those whose words have another digest than their source's."""
    start = spans.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = start + spans.field(1).to_numpy(zero_copy_only=False) + window - 1
    true = np.array([d is None or digest_of(row[a:b]) == d for a, b, d in zip(start.tolist(), end.tolist(), spans.field(2).to_pylist(), strict=True)], bool)
    return covered(start[true], np.minimum(end[true], len(row)))


def digests(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256) of every document."""
    joined, at = with_spans(id_text(docs), spans)

    def step(batch: pa.RecordBatch):
        data, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
        raw = data.tobytes()
        n, gone, runs, sha = [], [], [], []
        for k, own in enumerate(batch.column(batch.schema.get_field_index(at))):
            row = raw[offsets[k] : offsets[k + 1]].split()
            n.append(len(row))
            removed, cut = 0, 0
            if own.is_valid:
                a, b = repeats_of(own.values, row, window)
                removed, cut = int((b - a).sum()), len(a)
                edges = [0, *np.column_stack((a, b)).ravel().tolist(), len(row)]
                row = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in row[x:y]]
            gone.append(removed)
            runs.append(cut)
            sha.append(hashlib.sha256(b" ".join(row)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined, step, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with repeated words and the white space after them cut from the text.

    Texts without a repeat come back unchanged, null ones too; a text that is cut to nothing is ''.
    """
    joined, at = with_spans(docs, repeated_spans(docs, window, gram, id_col, text_col).read(), id_col)
    names, place = docs.columns, docs.columns.index(text_col)

    def step(batch: pa.RecordBatch):
        column = batch.column(place)
        data, offsets = buffers(column)
        starts, _, bounds = words(data, offsets)
        raw = data.tobytes()
        out = []
        for k, own in enumerate(batch.column(batch.schema.get_field_index(at))):
            if not column[k].is_valid:
                out.append(None)
                continue
            end = int(offsets[k + 1])
            text = raw[offsets[k] : end]
            if not own.is_valid:
                out.append(text.decode())
                continue
            lo, hi = int(bounds[k]), int(bounds[k + 1])
            a, b = repeats_of(own.values, text.split(), window)
            parts, last = [], int(offsets[k])
            for x, y in zip((a + lo).tolist(), (b + lo).tolist(), strict=True):
                parts.append(raw[last : starts[x] if x < hi else end])
                last = int(starts[y]) if y < hi else end
            out.append(b"".join([*parts, raw[last:end]]).decode())
        arrays = [pa.array(out, pa.string()) if i == place else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(joined, step, docs.schema)


def op1_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return digests(docs, repeated_spans(docs).read())


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT g.doc_id, g.i, unnest(range(0, 50)) AS k FROM g JOIN m USING (h) WHERE m.lo < g.doc_id)),
l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
s AS (SELECT doc_id, list(j ORDER BY j) AS firsts FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS b FROM c) WHERE b IS NULL OR b < j - 1 GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       CAST(coalesce(len(firsts), 0) AS BIGINT) AS n_spans,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""
