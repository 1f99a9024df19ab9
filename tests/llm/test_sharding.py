"""The query's shards against an independent draw, and its slots, sizes and checksums against plain Python."""

import math
import struct
import zlib
from collections import defaultdict

import xxhash

from larkspur.llm import registry, sharding


def draw(doc_id: int, name: str, weight: float) -> float:
    h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()).intdigest()
    return -math.log(((h >> 12) + 0.5) / 2**52) / weight


def shard_of(doc_id: int, shards: int) -> int:
    """Region, rack and shard by the smallest weighted draw, from the layout alone: two shards a rack, two racks a region."""
    left = list(range(shards))
    for name, group in (("region", lambda s: s // 4), ("rack", lambda s: s // 2), ("shard", lambda s: s)):
        sizes = defaultdict(int)
        for s in left:
            sizes[group(s)] += 1
        best = min(sizes, key=lambda g: draw(doc_id, f"{name}{g}", float(sizes[g])))
        left = [s for s in left if group(s) == best]
    return left[0]


def test_query_against_plain_draws(spark, small):
    got = registry.QUERIES["op9_hash_tree_shards"](spark, small).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert (r.shard, r.grown_shard) == (shard_of(r.doc_id, 8), shard_of(r.doc_id, 9))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_clashing_columns_and_ties(spark):
    """Columns named like the operator's own, nulls, empty and long texts, repeated rows: one row for each, slots gapless."""
    rows = [(i, t, 1, 2, "x") for i, t in [(1, "a"), (1, "a"), (2, None), (None, "b"), (None, None), (3, ""), (4, "é" * 300_000), (1, "other")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int, bucket string")
    out = sharding.slots(sharding.assign(docs, [1.0] * 8)).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in out if r.doc_id == 1}) == 1 and {r.size for r in out} == {1, 2, 6, 600_001}
