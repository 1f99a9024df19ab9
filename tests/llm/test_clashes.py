"""Every operator beside columns that are named like its own, and on texts longer than a batch's piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, media, mixing, near_dedup, quality, substring_dedup, suffix_dedup, toxicity

NAMES = "size row doc value at component rep position bucket near_of span_at span_doc q_words q_lines kept n low s1 s2 key nw hot rounds total nth ids decoded score tensor words starts".split()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")


@pytest.mark.parametrize("op", ["near", "repeats", "mix", "toxic", "lines"])
def test_operators_that_return_documents(docs, labels, op):
    run = {"near": near_dedup.drop_near_duplicates, "repeats": substring_dedup.remove_repeats, "mix": mixing.mix, "toxic": lambda d: toxicity.drop_toxic(d, labels), "lines": quality.clean_lines}[op]
    few = docs.where("doc_id < 30 or doc_id is null")
    wide = few.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])
    out = run(wide)
    assert out.columns == wide.columns
    shown = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())
    assert shown(out) == shown(run(few))
    assert all(r[c] == k for r in out.limit(3).collect() for k, c in enumerate(NAMES))


def test_operators_that_return_digests(docs):
    few = docs.where("doc_id < 12")
    wide = few.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])
    for run in (suffix_dedup.byte_dedup, media.media_digests, lambda d: bpe.digests(d, bpe.default_path()), near_dedup.near_duplicates):
        shown = lambda df: sorted(str(tuple(r)) for r in df.collect())
        assert shown(run(wide)) == shown(run(few))


def test_texts_longer_than_a_piece(spark, labels):
    """A text of over 4 MB, one word of as much, beside small ones: whole, in every row-wise operator."""
    long, word = "some words, and more of them. " * 150_000, "x" * 4_500_000
    docs = spark.createDataFrame([(1, long), (2, word), (3, "short text."), (4, None)], "doc_id long, text string").repartition(1)
    tokens = {r.doc_id: r for r in bpe.digests(docs.where("doc_id <> 2"), bpe.default_path()).collect()}
    codec = bpe.Codec(bpe.default_path())
    assert tokens[1].n_tokens == len(np.frombuffer(codec.encode([long.encode()])[0], "<u4")) and tokens[4].n_tokens == 0
    assert {r.doc_id: r.n_bytes for r in media.media_digests(docs).collect()} == {1: len(long), 2: len(word), 3: 11, 4: 0}
    scored = toxicity.toxic_scores(docs, labels).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    got = {r.doc_id: r for r in suffix_dedup.byte_dedup(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (len(long) - 30, len(word) - 1, 0)
