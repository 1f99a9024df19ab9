"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Stages return the columns of ``documents``; the last returns one row for each training position with its token
digests. Each stage works on all its predecessor kept.

Defined results: null and empty texts are clean, no copies of anything, without repeats, and are never taken into the
mix, so they have no row in the end; rows without a doc_id pass the first three stages and are mixed like any other;
repeated rows are one document for toxicity and near duplicates and rows of their own in the mix; a null source
is a source of its own; an empty table gives none; extra columns pass through to the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._frames import documents
from larkspur.llm._store import Table
from larkspur.llm.bpe import default_path, digests
from larkspur.llm.mixing import mix
from larkspur.llm.near_dedup import drop_near_duplicates
from larkspur.llm.substring_dedup import remove_repeats
from larkspur.llm.toxicity import drop_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too are cut."""
    return _counted(remove_repeats(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: documents repeated, cut or left out so that sources meet their targets."""
    return _counted(mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each training row."""
    return digests(docs, default_path())


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("mixing", mixing),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; between two stages the rows are a table in the shared folder."""
    docs, held = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        table = Table(out, f"stage{k + 1}")
        if held is not None:
            held.drop()
        docs, held = table.read(), table
    return docs


#: SQL cannot express the toxicity model or the tokenizer; tests/llm holds the stages and run() against a plain-Python
#: version of them, which takes the toxicity predictions as given, on whole small tables and on edge rows.
ORACLE_SQL = None
