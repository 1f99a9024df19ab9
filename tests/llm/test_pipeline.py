"""The pipeline against a plain-Python version of its stages, taking only the toxicity predictions as given."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from test_dedup import WORD, brute_near, brute_words

import corpus_pipeline
from larkspur.llm import bpe, registry, toxicity


def cut(text: str, gone: list[bool]) -> str:
    """Repeated words and the white space after them go."""
    out, last = [], 0
    spots = [m.start() for m in WORD.finditer(text)] + [len(text)]
    for k, g in enumerate(gone):
        if g:
            out.append(text[last : spots[k]])
            last = spots[k + 1]
    return "".join(out) + text[last:]


def without_repeats(rows):
    least = {}
    words = [WORD.findall(t or "") for _, t, _ in rows]
    for (i, _, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - 49 if i is not None else 0):
            k = tuple(w[p : p + 50])
            least[k] = min(i, least.get(k, i))
    out = []
    for (i, t, s), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if least[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        out.append((i, cut(t, gone) if any(gone) else t, s))
    return out


def targets(sizes):
    """Water filling round by round: what stops at three times its size leaves the rest to the others."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in full or free:
            out[s] = 3.0 * sizes[s] if full else level * weight[s]
        left -= sum(out[s] for s in full)
        free = free - full if full else set()
    return out


def mixed(rows):
    by = defaultdict(list)
    for i, t, s in rows:
        size = len(WORD.findall(t or ""))
        by[s].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, size, i, t))
    out, target = [], targets({s: sum(d[2] for d in docs) for s, docs in by.items()})
    for s, docs in by.items():
        need = int(target[s] + 0.5)
        while need > 0:
            for _, _, size, i, t in sorted(docs, key=lambda d: d[:3]):
                take = min(size, need)
                if take:
                    out.append((i, t if take == size else " ".join(WORD.findall(t)[:take])))
                need -= take
    return out


def brute(rows, toxic):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, text, source)."""
    from tokenizers import Tokenizer

    rows = [r for r, bad in zip(rows, toxic, strict=True) if not bad]
    kept = {k[0] for k in brute_near([(i, t) for i, t, _ in rows], 5, 80) if k[3]}
    rows = mixed(without_repeats([r for r in rows if r[0] is None or r[0] in kept]))
    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_truncation(), tokenizer.no_padding()
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def compare(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    predicted = {(r.doc_id, r.n): r.predicted for r in toxicity.toxic_scores(docs, labels).selectExpr("doc_id", "predicted", "row_number() over (partition by doc_id order by predicted) as n").collect()}
    count, toxic = defaultdict(int), []
    for i, _, _ in rows:
        count[i] += 1
        toxic.append(predicted[(i, count[i])] if count[i] == 1 or predicted[(i, 1)] == predicted[(i, count[i])] else pytest.skip("rows of one doc_id differ"))
    want = brute(rows, toxic)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        docs = out
    assert sorted((tuple(r) for r in docs.collect()), key=str) == want
    return want


def test_run_against_brute_force(spark, small):
    want = compare(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    got = corpus_pipeline.run(spark, small)
    assert len(want) > 100 and sorted((tuple(r) for r in got.collect()), key=str) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "substring dedup", "mixing", "bpe"]


def test_edge_rows(docs, small, spark):
    """Nulls in any column, empty, blank, long and repeated texts, ties, other columns: all stages, same as brute force."""
    compare(spark, docs, small)


def test_empty_table(nothing, small, spark):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_registry_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert brute_words([(1, "a")], 50)[0][1] == 1
