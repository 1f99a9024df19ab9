"""Operators 1, 2 and 5 against brute force."""

import hashlib
import re

import pytest

from larkspur.llm import near_dedup, substring_dedup, suffix_dedup
from larkspur.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def runs_of(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def brute_words(texts, window):
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    least = {}
    for i, w in words:
        for p in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[p : p + window])
            least[k] = min(i, least.get(k, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), runs_of(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return sorted(out, key=str)


def brute_bytes(texts, window):
    first = {}
    data = [(i, (t or "").encode()) for i, t in texts]
    for i, b in data:
        for p in range(len(b) - window + 1) if i is not None else ():
            k = b[p : p + window]
            first[k] = min((i, p), first.get(k, (i, p)))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - window + 1) if i is not None else ():
            if first[b[p : p + window]] != (i, p):
                gone[p : p + window] = [True] * window
        out.append((i, len(b), sum(gone), runs_of(gone), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


def brute_near(texts, size, percent):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in texts]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted([(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets], key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_words(docs, texts):
    plain = substring_dedup.id_text(docs)
    assert rows(substring_dedup.digests(plain, substring_dedup.repeated_spans(docs).read())) == brute_words(texts, 50)


def test_words_short_window(docs, texts):
    plain = substring_dedup.id_text(docs)
    assert rows(substring_dedup.digests(plain, substring_dedup.repeated_spans(docs, 12, 4).read(), 12)) == brute_words(texts, 12)


def test_removal_keeps_columns_and_clean_texts(docs, texts):
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.pos: r.text for r in out.collect()}
    want = {n: k for n, k in enumerate(brute_words(texts, 50))}
    assert len(want) == len(got)
    for n, (i, t) in enumerate(texts):
        removed = next(k for k in brute_words([*texts], 50) if k[0] == i and k[1] == len(WORD.findall(t or "")))[2]
        if not removed:
            assert got[n] == t
        else:
            assert len(WORD.findall(got[n])) == len(WORD.findall(t)) - removed


def test_bytes(docs, texts):
    assert rows(suffix_dedup.byte_dedup(docs)) == brute_bytes(texts, 100)


@pytest.mark.parametrize("window,gram", [(100, 24), (40, 9)])
def test_bytes_when_every_minimizer_is_hot(docs, texts, spark, monkeypatch, window, gram):
    """Split buckets lose no repeat: all minimizers are taken as hot, and one has many different contexts."""
    import random

    rng = random.Random(4)
    phrase = "all of these share this very phrase of some length "
    more = [(5000 + i, "".join(rng.choice("ab ") for _ in range(120)) + phrase + "".join(rng.choice("ab ") for _ in range(120))) for i in range(60)]
    more += [(6000 + i, t[rng.randint(0, 100) :]) for i, (_, t) in enumerate(more[:30])]
    rows_ = [*texts, *more]
    everything = spark.createDataFrame(rows_, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert rows(suffix_dedup.byte_dedup(everything, window, gram)) == brute_bytes(rows_, window)


def test_bytes_with_content(docs, texts):
    for r in suffix_dedup.byte_dedup(docs, keep_bytes=True).collect():
        assert sha(bytes(r.kept)) == r.kept_sha256 and len(r.spans) == r.n_spans


def test_column_wise_construction():
    """Neighbours' common prefixes are those of the sorted rests."""
    import numpy as np

    strings = [b"abcabcab", b"abcabd", b"xbcabcab", b"", b"bcab"]
    data, bounds = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    for order, shared, column in suffix_dedup.columns(data, bounds, np.zeros(len(strings), np.int64), 200):
        rests = [strings[i][column:] for i in order]
        live = [r for r in rests if r]
        assert live == sorted(live)
        for k in range(1, len(rests)):
            a, b = rests[k - 1], rests[k]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == (n if a and b else 0)


@pytest.mark.parametrize("size,percent", [(4, 80), (5, 50)])
def test_near(docs, texts, size, percent):
    assert rows(near_dedup.near_duplicates(docs, size, percent)) == brute_near(texts, size, percent)


def test_near_group_without_pairs(spark):
    """A chain of near copies, large groups and hot shingles come out as brute force has them."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for i in range(80):  # each has one more change: a chain whose ends are far apart
        base = [*base]
        base[(i * 7) % 120] = f"c{i}"
        texts.append((i, " ".join(base)))
    texts += [(1000 + i, "common words that all of these share at once " + " ".join(f"u{i}_{k}" for k in range(9))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(docs, 4)) == brute_near(texts, 4, 80)


def thue_morse(n, a="a", b="b"):
    """Two words that polynomials modulo 2**64 cannot tell apart from 1,024 letters on."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [11])
def test_words_that_polynomials_confuse(spark, n):
    x, y = thue_morse(n)
    tail = " ".join(f"t{i}" for i in range(60))
    texts = [(0, f"{x} {tail}"), (1, f"{y} {tail}"), (2, x), (3, y), (4, " ".join(thue_morse(n)[0])), (5, " ".join(thue_morse(n)[1])), (6, f"{x} one two three"), (7, f"{y} one two three")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(substring_dedup.digests(docs, substring_dedup.repeated_spans(docs).read())) == brute_words(texts, 50)
    assert rows(near_dedup.near_duplicates(docs, 4)) == brute_near(texts, 4, 80)
    assert rows(suffix_dedup.byte_dedup(docs)) == brute_bytes(texts, 100)


def test_a_span_whose_words_differ_from_its_source_stays(docs, spark):
    """Source verification: a claimed repeat is cut only if its words have the digest of its source's."""
    text = " ".join(f"w{i}" for i in range(60))
    good = substring_dedup.digest_of([f"w{i}".encode() for i in range(50)])
    for digest, removed in ((good, 50), (b"x" * 16, 0), (None, 50)):
        spans = spark.createDataFrame([(7, 0, 1, digest)], "doc long, pos int, windows int, digest binary")
        one = spark.createDataFrame([(7, text)], "doc_id long, text string")
        assert substring_dedup.digests(one, spans).first().n_removed == removed


def edited(rng, words, share):
    return [f"e{rng.randint(0, 10**9)}" if rng.random() < share else w for w in words]


def test_recall_on_planted_pairs(spark):
    """Every pair of 0.8 and more among near copies of all sizes, from a few words to thousands, is met."""
    import random

    rng = random.Random(11)
    texts = []
    for g in range(60):
        base = [f"b{g}_{i}" for i in range(rng.choice([5, 9, 20, 60, 130, 300, 900, 2500]))]
        texts += [(g * 10 + k, " ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])))) for k in range(4)]
    rng.shuffle(texts)
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4))
    want = brute_near(texts, 4, 80)
    assert got == want and sum(1 for r in want if not r[3]) > 60


def test_a_group_makes_few_pairs(spark):
    """400 near copies, most of them just short of each other: the pairs that are counted stay far below 400 ** 2 / 2."""
    import random

    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [(i, " ".join(edited(rng, base, 0.03))) for i in range(400)]
    met = []
    real = near_dedup.counted
    near_dedup.counted = lambda pairs, sets, percent: (met.append(pairs.count()), real(pairs, sets, percent))[1]
    try:
        got = rows(near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4))
    finally:
        near_dedup.counted = real
    assert got == brute_near(texts, 4, 80) and sum(met) < 8000, met


@pytest.mark.parametrize("percent", [0, 101, -5])
def test_percent_out_of_range(nothing, percent):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(nothing, 4, percent)


def test_long_texts(spark):
    """Texts beyond the block of 2 ** 19 symbols and beyond a batch's piece of 8 MB."""
    import random

    rng = random.Random(2)
    shared = [f"s{i}" for i in range(200)]
    many = [str(rng.randint(0, 10**6)) for _ in range(560_000)]
    texts = [(0, " ".join(shared)), (1, " ".join([*many[:524_200], *shared, *many[524_200:]])), (2, " ".join([*shared[:49], "x", *shared[60:]])), (3, "y" * 9_000_000), (4, "z" + "y" * 200), (5, " ".join(many[524_000:524_400]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert rows(substring_dedup.digests(docs, substring_dedup.repeated_spans(docs).read())) == brute_words(texts, 50)
    assert rows(near_dedup.near_duplicates(docs, 4)) == brute_near(texts, 4, 80)


def test_drop_near(docs, texts):
    kept = near_dedup.drop_near_duplicates(docs)
    want = {k[0] for k in brute_near(texts, 5, 80) if k[3]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3), (5, 4), (4, 6), (6, 7), (7, 20), (20, 19)], "a long, b long")
    got = {r.node: r.component for r in components(links).read().collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4, 5: 4, 6: 4, 7: 4, 20: 4, 19: 4}


def test_empty_tables(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.byte_dedup(nothing).count() == 0
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("op", ["op1_debruijn_dedup", "op2_suffix_dedup", "op5_bottom_k_near"])
def test_against_sql(spark, small, compare, op):
    from larkspur.llm import registry

    compare(registry.QUERIES[op](spark, small), registry.ORACLE_SQL[op], small)
