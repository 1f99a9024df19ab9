"""Operator 9, sharding by a hierarchical weighted hash tree: region, rack, shard (law ``key``).

At each level a document draws -ln(u) / weight for every child of the node it stands in, u hashed from doc_id and
the child's name, and goes to the smallest draw. A node's weight is the sum of its shards', so a change of weight
moves rows only into or out of the subtrees on its path. A new shard opens in a rack and region of its own when
the last rack is full, so growing from 8 to 9 shards takes rows into the new shard alone.

Slots number each shard's rows without gaps. Rows are counted by shard and hash bucket (4096), the counts are
summed over that small table, and the last step numbers rows within one bucket; no task holds a whole shard.

Defined results: a null text has size 1 and the checksum of the empty text; a null doc_id hashes like any other
value; repeated rows get slots of their own in the same shard; equal texts share their checksum; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._frames import documents
from larkspur.llm._store import Table

SHARDS, PER_RACK, RACKS_PER_REGION, BUCKETS = 8, 2, 2, 4096
LEVELS = 3


@dataclass
class Tree:
    """Nodes by number, 0 the root: stable names, weights, children; a leaf's shard."""

    names: list[str] = field(default_factory=lambda: ["root"])
    weights: list[float] = field(default_factory=lambda: [0.0])
    children: list[list[int]] = field(default_factory=lambda: [[]])
    shards: list[int] = field(default_factory=lambda: [-1])

    def node(self, parent: int, name: str, shard: int = -1) -> int:
        if name in self.names:
            return self.names.index(name)
        self.names.append(name)
        self.weights.append(0.0)
        self.children.append([])
        self.shards.append(shard)
        self.children[parent].append(len(self.names) - 1)
        return len(self.names) - 1


def tree(weights: list[float], per_rack: int = PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> Tree:
    """Shard s stands in rack s // per_rack and region rack // racks_per_region."""
    out = Tree()
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        rack = shard // per_rack
        region = out.node(0, f"region{rack // racks_per_region}")
        at = out.node(region, f"rack{rack}")
        leaf = out.node(at, f"shard{shard}", shard)
        for n in (0, region, at, leaf):
            out.weights[n] += weight
    return out


def uniform(key: Column, name: Column) -> Column:
    """In (0, 1), from 52 bits of a hash of the key and the child's name."""
    return (F.shiftrightunsigned(F.xxhash64(key, name), 12) + 0.5) / float(1 << 52)


def descend(key: Column, t: Tree) -> Column:
    """The shard of a key."""
    children = F.array(*[F.array(*[F.lit(c) for c in kids]) if kids else F.array().cast("array<int>") for kids in t.children])
    names, weights = F.array(*[F.lit(x) for x in t.names]), F.array(*[F.lit(x) for x in t.weights])
    at = F.lit(0)
    for _ in range(LEVELS):
        draws = F.transform(F.element_at(children, at + 1), lambda c: F.struct((-F.ln(uniform(key, F.element_at(names, c + 1))) / F.element_at(weights, c + 1)).alias("draw"), c.alias("node")))
        at = F.array_min(draws)["node"]
    return F.element_at(F.array(*[F.lit(x) for x in t.shards]), at + 1)


def slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard, to rows with shard, bucket, doc_id and text_crc32."""
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), (F.sum("n").over(order) - F.col("n")).alias("offset"))
    joined = rows.join(offsets, (rows.shard == offsets.of_shard) & (rows.bucket == offsets.of_bucket))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return joined.withColumn("slot", F.col("offset") + F.row_number().over(within) - 1)


def assign(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, bucket, shard) under the given shard weights."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("slot")), F.lit(BUCKETS)).cast("int")).withColumn("shard", descend(F.col("doc_id"), tree(weights)))


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(documents(spark, sf_dir), [1.0] * SHARDS).withColumn("grown_shard", descend(F.col("doc_id"), tree([1.0] * (SHARDS + 1))))
    return slots(Table(rows, "shards").read()).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
