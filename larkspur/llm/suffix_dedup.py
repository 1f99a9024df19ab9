"""Operator 2, suffix-array dedup: column-wise construction over byte windows aligned at their minimizers.

Inserting one symbol of every whole document in each round takes as many rounds as the longest document has
bytes, and each round rewrites the whole transform. Here the strings are short and aligned instead: one pass cuts
each document into runs of consecutive 100-byte windows that share a minimizer occurrence (at most 77 windows).
Equal windows have equal minimizers at equal offsets, so runs are compared only within one minimizer's bucket
and only column by column, counted from the minimizer. Equal runs meet by their hash. The different runs of a
bucket are read again at their coordinates and enter the column-wise construction: each round inserts one byte
of every run at the next column to the left, moves the run's entry by a stable counting sort (the LF step of the
collection's transform) and updates the common prefix lengths of neighbours. Entries whose common prefix
reaches 100 bytes are equal windows. At most 176 rounds, each linear in the block; the sequential files between
the steps are Spark's shuffle files and one written table.

Hot keys: each map task keeps one run of equal ones and reports the others at once, so a bucket gets at most
one row for each task and distinct run. Minimizers that a sample of the documents (one in SAMPLE) has HOT times or more
are split: their equal runs meet by the run's hash, and their different runs enter the construction by a longer key.
A window holds the 38 bytes before its minimizer or the 38 after it, so each run is listed under the hash of either
side with the minimizer, and equal windows share one of the two buckets. That is exact whatever the sample finds; a
bucket of runs that share all of these 62 bytes stays whole.

Defined results: null text has no bytes; a text under 100 bytes keeps all; a null doc_id is neither a source nor
changed; rows that repeat a doc_id with equal text get equal results, as their starts are not earlier.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._frames import documents, id_text, map_arrow, ship
from larkspur.llm._store import Table, scratch
from larkspur.llm._text import BASES, U64, buffers, covered, gram_hashes, segments, word_hashes

WINDOW = 100
GRAM = 24
#: Strings of one construction; bounds its memory, and buckets stay whole.
BLOCK_STRINGS = 1 << 15
#: One document in SAMPLE tells which minimizers are hot: those it has HOT times or more.
SAMPLE, HOT = 64, 32
RUNS = "key long, sh long, doc long, pos int, nw int"
MET = f"{RUNS}, hot boolean"


def _batch(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names.split())


def _first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """For sorted parallel keys: True where a new value begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def byte_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, sh, doc, pos, nw). The first of equal runs in a batch has its minimizer as key; the others are
    repeats already, with nw negated and a key of their own document."""

    def step(batch: pa.RecordBatch):
        data, bounds = buffers(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = list(segments(data, bounds, window, gram))
        if not parts:
            return None
        mh, sh, doc, pos, nw = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = ids[doc]
        order = np.lexsort((pos, doc, sh, mh))
        mh, sh, doc, pos, nw = mh[order].view(np.int64), sh[order].view(np.int64), doc[order], pos[order], nw[order]
        first = _first_of_equal(mh, sh)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        same = ~first & (doc == doc[lead]) & (pos == pos[lead])  # repeated rows of one document
        keep = ~same
        return _batch("key sh doc pos nw", np.where(first, mh, doc)[keep], sh[keep], doc[keep], pos[keep].astype(np.int32), np.where(first, nw, -nw)[keep].astype(np.int32))

    return map_arrow(docs.where("doc_id is not null"), step, RUNS)


def hot_keys(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The minimizers that a sample of the documents has often."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    return byte_runs(some, window, gram).where("nw > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).select(F.col("key").alias("hot_key"))


def meet(runs: DataFrame, hot: DataFrame) -> DataFrame:
    """Within each minimizer's bucket: repeats of an equal earlier run (nw < 0), and one of each different run.

    Of a hot minimizer, equal runs meet by their hash and each different run is kept.
    """
    marked = runs.join(hot, (F.col("key") == F.col("hot_key")) & (F.col("nw") > 0), "left").select("key", "sh", "doc", "pos", "nw", F.col("hot_key").isNotNull().alias("hot"))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, sh, doc, pos, nw, split = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in parts]) for k in range(6))
        done = nw < 0
        if done.any():
            yield _batch("key sh doc pos nw hot", key[done], sh[done], doc[done], pos[done], nw[done], split[done])
        key, sh, doc, pos, nw, split = (x[~done] for x in (key, sh, doc, pos, nw, split))
        if not len(key):
            return
        order = np.lexsort((pos, doc, sh, key))
        key, sh, doc, pos, nw, split = (x[order] for x in (key, sh, doc, pos, nw, split))
        bucket, first = _first_of_equal(key), _first_of_equal(key, sh)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = ~first & ((doc != doc[lead]) | (pos != pos[lead]))
        of = np.cumsum(bucket) - 1
        different = first & ((np.bincount(of, first)[of] > 1) | split)
        out = later | different
        yield _batch("key sh doc pos nw hot", key[out], sh[out], doc[out], pos[out], np.where(later, -nw, nw)[out].astype(np.int32), split[out])

    return ship(marked.repartition(F.when(F.col("hot"), F.xxhash64("key", "sh")).otherwise(F.col("key")))).mapInArrow(run, MET)


def longer_keys(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, key): runs under the hash of their minimizer with half a window's rest before it, and with that after it."""
    half = (window - gram) // 2
    at = bounds[:-1] + aligned_at(data, bounds, counts, gram)
    before = np.flatnonzero(at - half >= bounds[:-1])
    after = np.flatnonzero(at + gram + half <= bounds[1:])
    keys = np.concatenate((word_hashes(data, at[before] - half, at[before] + gram), word_hashes(data, at[after], at[after] + gram + half) ^ U64(0x5851F42D4C957F2D)))
    return np.concatenate((before, after)), keys.view(np.int64)


def run_bytes(joined: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, doc, pos, nw, bytes) of the runs listed with each document."""

    def step(batch: pa.RecordBatch):
        lists = batch.column(2)
        data, bounds = buffers(batch.column(1))
        at = lists.flatten()
        if not len(at):
            return None
        key, pos, nw, split = (at.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), count)
        start, size = bounds[doc] + pos, nw.astype(np.int64) + window - 1
        fits = start + size <= bounds[doc + 1]
        key, pos, nw, split, doc, start, size = (x[fits] for x in (key, pos, nw, split, doc, start, size))
        offsets = np.append(0, np.cumsum(size))
        source = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        joined_bytes = data[source]
        binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined_bytes.tobytes())])
        ids = batch.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        if split.any():
            plain, hot = np.flatnonzero(~split), np.flatnonzero(split)
            own = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in hot])
            row, keys = longer_keys(joined_bytes[own], np.append(0, np.cumsum(size[hot])), nw[hot].astype(np.int64), window, gram)
            take = np.concatenate((plain, hot[row]))
            key, ids, pos, nw, binary = np.concatenate((key[plain], keys)), ids[take], pos[take], nw[take], binary.take(pa.array(take))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(pos), pa.array(nw), binary], names=["key", "doc", "pos", "nw", "bytes"])

    return map_arrow(joined, step, "key long, doc long, pos int, nw int, bytes binary")


def aligned_at(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray, gram: int) -> np.ndarray:
    """Offset of each run's minimizer: the leftmost smallest gram common to its windows."""
    out = np.zeros(len(counts), np.int64)
    if not len(counts):
        return out
    grams = gram_hashes(data, gram, BASES[1]) >> U64(21)
    # all windows of the run contain the grams from nw - 1 to window - gram of its text
    lo = bounds[:-1] + counts - 1
    hi = bounds[1:] - gram - (counts - 1)
    span = hi - lo + 1
    top = np.append(0, np.cumsum(span))
    at = np.repeat(lo - top[:-1], span) + np.arange(top[-1])
    values = grams[at]
    least = np.minimum.reduceat(values, top[:-1])
    hit = np.flatnonzero(values == np.repeat(least, span))
    row = np.searchsorted(top, hit, "right") - 1
    first = _first_of_equal(row)
    out[row[first]] = at[hit[first]] - bounds[:-1][row[first]]
    return out


def columns(data: np.ndarray, bounds: np.ndarray, anchors: np.ndarray, depth: int):
    """Column-wise construction over strings aligned at ``anchors``, from the last column to the first.

    Yields for each column (string numbers in order, common prefix with the one before, capped at depth,
    column); the order is that of the strings' rests from this column on.
    """
    n = len(anchors)
    left, right = -anchors, np.diff(bounds) - anchors
    base = bounds[:-1] + anchors
    order, shared = np.arange(n), np.zeros(n, np.uint8)
    wide = data.astype(np.uint16) + 1
    for column in range(int(right.max()) - 1, int(left.min()) - 1, -1):
        inside = (left <= column) & (column < right)
        symbol = np.zeros(n, np.uint16)
        symbol[inside] = wide[base[inside] + column]
        symbol = symbol[order]
        moved = np.argsort(symbol, kind="stable")
        symbol = symbol[moved]
        after = np.zeros(n, np.uint8)
        pairs = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
        if len(pairs):
            lo, hi = moved[pairs - 1] + 1, moved[pairs]
            one = lo == hi
            least = np.empty(len(pairs), np.uint8)
            least[one] = shared[lo[one]]
            far = np.flatnonzero(~one)
            if len(far):
                ends = np.empty(2 * len(far), np.int64)
                ends[::2], ends[1::2] = lo[far], hi[far] + 1
                padded = np.append(shared, np.uint8(255))
                least[far] = np.minimum.reduceat(padded, ends)[::2]
            after[pairs] = np.minimum(least, depth - 1) + 1
        order, shared = order[moved], after
        yield order, shared, column


def repeats(data: np.ndarray, bounds: np.ndarray, anchors: np.ndarray, doc: np.ndarray, pos: np.ndarray, counts: np.ndarray, window: int):
    """(string, offset) of the windows that another string has earlier (smaller doc, or same doc and smaller pos)."""
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((pos, doc))] = np.arange(len(doc))
    found_s, found_o = [], []
    for order, shared, column in columns(data, bounds, anchors, window):
        tied = shared >= window
        if not tied.any():
            continue
        # groups: runs of tied entries with the entry before each run
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        head = ~tied[at]
        group = np.cumsum(head) - 1
        who = order[at]
        off = column + anchors[who]
        start_doc, start_pos = doc[who], pos[who] + off
        by = np.lexsort((start_pos, start_doc, group))
        who, off, group, start_doc, start_pos = who[by], off[by], group[by], start_doc[by], start_pos[by]
        lead = np.flatnonzero(_first_of_equal(group))[group]
        late = ((start_doc != start_doc[lead]) | (start_pos != start_pos[lead])) & (off < counts[who])
        found_s.append(who[late])
        found_o.append(off[late])
    if not found_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_s), np.concatenate(found_o)


def compare(strings: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, pos, windows): runs of windows that stand earlier too, among the different runs of each bucket."""

    def block(table: pa.Table):
        key, doc, pos, nw = (table.column(k).to_numpy() for k in range(4))
        data, bounds = buffers(table.column(4))
        anchors = aligned_at(data, bounds, nw.astype(np.int64), gram)
        who, off = repeats(data, bounds, anchors, doc, pos, nw, window)
        if not len(who):
            return None
        order = np.lexsort((off, who))
        who, off = who[order], off[order]
        cut = _first_of_equal(who)
        cut[1:] |= off[1:] != off[:-1] + 1
        first = np.flatnonzero(cut)
        return _batch("doc pos windows", doc[who[first]], (pos[who[first]] + off[first]).astype(np.int32), np.diff(first, append=len(who)).astype(np.int32))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by("key")
        key = table.column(0).to_numpy()
        new = np.append(np.flatnonzero(_first_of_equal(key)), len(key))
        at = 0
        while at < len(key):
            stop = int(new[max(np.searchsorted(new, at + BLOCK_STRINGS, "right") - 1, np.searchsorted(new, at, "right"))])
            out = block(table.slice(at, stop - at).combine_chunks())
            if out is not None:
                yield out
            at = stop

    return ship(strings.repartition("key")).mapInArrow(run, "doc long, pos int, windows int")


def with_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, starts, sizes): each text with its runs of windows that stand earlier too (null: none)."""
    with scratch():
        hot = Table(hot_keys(docs, window, gram), "hot-keys")
        met = Table(meet(byte_runs(docs, window, gram), hot.read()), "byte-runs").keep().read()
    dealt = docs.repartition("doc_id")
    wanted = met.where("nw > 0").groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("key", "pos", "nw", "hot")).alias("at"))
    strings = run_bytes(dealt.join(wanted, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "at"), window, gram)
    spans = met.where("nw < 0").select("doc", "pos", (-F.col("nw")).alias("windows")).unionByName(compare(strings, window, gram))
    lists = spans.groupBy(F.col("doc").alias("of")).agg(F.collect_list("pos").alias("starts"), F.collect_list("windows").alias("sizes"))
    return dealt.join(lists, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "starts", "sizes")


def byte_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, on demand, spans and the remaining bytes ``kept``.

    The remaining bytes are binary: a cut may fall within a character.
    """
    joined = with_repeats(id_text(docs, id_col, text_col), window, gram)

    def step(batch: pa.RecordBatch):
        data, bounds = buffers(batch.column(1))
        raw = data.tobytes()
        n, gone, runs, sha, kept, spans = [], [], [], [], [], []
        for k in range(batch.num_rows):
            lo, hi = int(bounds[k]), int(bounds[k + 1])
            starts = batch.column(2)[k]
            a = b = np.zeros(0, np.int64)
            rest = raw[lo:hi]
            if starts.is_valid:
                s = starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                a, b = covered(s, s + batch.column(3)[k].values.to_numpy(zero_copy_only=False) + window - 1)
                edges = [0, *np.column_stack((a, b)).ravel().tolist(), hi - lo]
                rest = b"".join(rest[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            n.append(hi - lo)
            gone.append(int((b - a).sum()))
            runs.append(len(a))
            sha.append(hashlib.sha256(rest).hexdigest())
            if keep_bytes:
                kept.append(rest)
                spans.append(np.column_stack((a, b)).tolist())
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_bytes:
            arrays += [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            names += ["kept", "spans"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    more = ", kept binary, spans array<array<long>>" if keep_bytes else ""
    return map_arrow(joined, step, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
p AS (SELECT doc_id, unnest(range(0, n - 99)) AS i, x FROM n WHERE n >= 100),
g AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM p),
f AS (SELECT doc_id, i, min(struct_pack(a := doc_id, b := i)) OVER (PARTITION BY h) AS lo FROM g),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE lo.a < doc_id OR lo.b < i),
s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
c AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prior FROM c),
o AS (SELECT e.doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans, max(b) AS last,
             string_agg(substr(x, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN o USING (doc_id)
"""
