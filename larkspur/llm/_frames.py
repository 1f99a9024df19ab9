"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it in any case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that extra columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: Most bytes of an Arrow batch between Spark and a Python worker; both hold several. Spark counts rows otherwise.
BATCH = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(df: DataFrame) -> DataFrame:
    """Let Python workers find this package where it stands (on a cluster without a shared disk: --py-files), and get
    batches of a bounded size, whatever the length of the texts."""
    conf = df.sparkSession.conf
    have = conf.get(BATCH_SETTING).rstrip("b")  # bytes, as a user may have set it lower
    if not have.isdigit() or int(have) > BATCH:
        conf.set(BATCH_SETTING, str(BATCH))
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [root, *have] if x)
    for name in ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_"):
        env.setdefault(name, str(1 << 20))  # a worker gives large arrays back when they are freed
    return df


#: Bytes of a batch that an operator works on at once; bounds the memory of a Python worker.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PIECE bytes, without a copy."""
    rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one piece of a batch."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                out = step(piece)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return ship(df).mapInArrow(run, schema)
