"""Operator 6, toxicity: noisy-channel deobfuscation, then a score of the restored text.

Words that look disguised (letters next to look-alike digits or signs, a letter three times in a row, letters with a
mark between them as in ``stu-pid`` and ``st*pid``, single letters set apart) are decoded: a lattice has for each
character the letters it may stand for, a repeated letter may be dropped, separators vanish, an asterisk is any letter
or none, and Viterbi search under a character trigram model finds the likeliest word. The trigrams are counted over all
documents, each by itself. What is scored is the restored text: a disguised token counts once, as its decoding or, if
that scores higher, as its letters stand.

The score comes from words and word beginnings that mark toxic texts, learnt from labelled rows outside the held-out
quarter: each has the log ratio of its rates in toxic and clean texts, and a logistic regression turns a text's summed
and largest ratios and its length into a probability. Words of any length can be marks; beginnings have SHORTEST to
LONGEST letters. A doubled letter (``stuupid``) alone does not make a token look disguised, as most such words are not;
it counts by what learnt beginning survives.

The classifier is fitted on a bounded sample (FIT_TOXIC and FIT_CLEAN labelled rows, the smallest by a hash of doc_id);
the trigram counts, and scoring, take all rows. What comes to the driver is bounded: 21,952 trigram counts and
MARKS marks.

Defined results: null and empty texts score as texts without a mark; a null doc_id is not held out and never labelled;
without enough labels there are no marks and every text gets the base rate; repeated rows score alike; extra columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._frames import documents, id_text, pieces, ship
from larkspur.llm._store import Table
from larkspur.llm._text import buffers, words

FIT_TOXIC, FIT_CLEAN, MARKS = 4000, 8000, 512
THRESHOLD = 0.3
SHORTEST, LONGEST = 4, 8
LETTERS = 28
#: Code of each byte: 0 a boundary, 1 to 26 a letter, 27 a byte of another letter.
CODE = np.zeros(256, np.uint8)
CODE[97:123] = CODE[65:91] = np.arange(1, 27)
CODE[128:] = 27
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
LETTER = CODE > 0
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Words and tokens whose ratios a worker remembers.
HELD = 50_000
#: A token with more asterisks than this has them as separators, not as letters.
MASKS = 4
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = _ASCII[65:91] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in " .-_*~"]] = True
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[ord(c) for c in ".-_*~"]] = True
_RUN = re.compile(rb"[a-z\x80-\xff]+")
_SPACED = re.compile(rb"(?<![A-Za-z0-9@$!|])[A-Za-z0-9@$!|](?:[ .\-_*~][A-Za-z0-9@$!|]){2,}(?![A-Za-z0-9@$])")
_CORE = re.compile(rb"^[^A-Za-z0-9@$!|+(]+|[^A-Za-z0-9@$]+$")
SUBSTITUTED, DROPPED, KEPT, MASKED = math.log(0.15), math.log(0.5), math.log(0.85), math.log(0.5 / 26)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


# --- character model ---------------------------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the codes' trigrams over all texts; a text begins and ends at boundaries."""

    def run(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = buffers(piece.column(0))
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                # two boundaries before, between and after the texts: no trigram is of two of them
                codes = np.insert(CODE[data], np.repeat(np.append(bounds[full], len(data)), 2), 0)
                for at in range(0, len(codes) - 2, 1 << 18):
                    c = codes[at : at + (1 << 18) + 2].astype(np.int32)
                    total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["code", "n"])

    rows = ship(docs.select("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LETTERS**3, np.int64)
    for r in rows:
        counts[r.code] = r.n
    return counts


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams smoothed with bigrams."""
    tri = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    bi = tri.sum(axis=0) + 0.1
    low = bi / bi.sum(axis=1, keepdims=True)
    return np.log((tri + 5 * low[None]) / (tri.sum(axis=2, keepdims=True) + 5))


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a disguised token."""
    beams: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    masks = token.count("*") <= MASKS
    for ch in token.lower():
        options = [(ch, KEPT)] if "a" <= ch <= "z" else [(x, MASKED) for x in ALPHABET] if ch == "*" and masks else [(x, SUBSTITUTED) for x in LEET.get(ch, "")]
        if not options:
            continue  # a separator
        ahead: dict[tuple[int, int], tuple[float, str]] = {key: (p + DROPPED, text) for key, (p, text) in beams.items()} if ch == "*" else {}
        for (a, b), (p, text) in beams.items():
            for x, cost in options:
                c = ord(x) - 96
                steps = [((b, c), p + cost + model[a, b, c], text + x)]
                if c == b:
                    steps.append(((a, b), p + cost + DROPPED, text))
                for key, q, t in steps:
                    if key not in ahead or ahead[key][0] < q:
                        ahead[key] = (q, t)
        beams = ahead
    return max((p + model[a, b, 0], t) for (a, b), (p, t) in beams.items())[1]


def decodings(token: str, model: np.ndarray) -> list[str]:
    """The Viterbi reading, and the reading that keeps at most one letter of each run of three or more."""
    once = re.sub(r"(.)\1{2,}", r"\1", token)
    return list(dict.fromkeys([decode(token, model), decode(once, model)]))


# --- words and marks ---------------------------------------------------------------------------------------------


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data]
    edge = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    first = inside[1:-1] & ~inside[:-2]
    first[edge] = inside[1:-1][edge]
    last = inside[1:-1] & ~inside[2:]
    last[edge - 1] = inside[1:-1][edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def suspects(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """The disguised tokens: row, first byte, byte after the last, the token without what stands around or between."""
    n = len(data)
    if n < 2:
        return []
    letter, sign = _ASCII[data], _SIGN[data]
    hit = np.zeros(n, bool)
    hit[:-1] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    low = LOW[data]
    hit[:-2] |= (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[:-2]
    hit[:-2] |= letter[:-2] & _BETWEEN[data[1:-1]] & letter[2:]
    apart = _APART[data]
    one = letter | sign
    spaced = one[:-4] & apart[1:-3] & one[2:-2] & apart[3:-1] & one[4:] if n > 4 else np.zeros(0, bool)
    starts, ends, firsts = words(data, bounds)
    raw = data.tobytes()
    out: list[tuple[int, int, int, bytes]] = []
    for doc in np.unique(np.searchsorted(bounds, np.flatnonzero(spaced), "right") - 1).tolist():
        lo = int(bounds[doc])
        for m in _SPACED.finditer(raw[lo : bounds[doc + 1]]):
            out.append((doc, lo + m.start(), lo + m.end(), re.sub(rb"[ .\-_*~]", b"", m[0])))
    taken = np.array([x for _, a, b, _ in out for x in (a, b)], np.int64)
    at = np.unique(np.searchsorted(starts, np.flatnonzero(hit), "right") - 1)
    at = at[at >= 0]
    at = at[np.searchsorted(taken, starts[at], "right") % 2 == 0]  # not within one set apart
    for k, doc in zip(at.tolist(), (np.searchsorted(firsts, at, "right") - 1).tolist(), strict=True):
        token = raw[starts[k] : ends[k]]
        token = _CORE.sub(b"", token[1:] if token[:1] == b"(" and b")" in token else token)
        if any(97 <= c <= 122 for c in token.lower()):
            out.append((doc, int(starts[k]), int(ends[k]), token))
    return out


def parts_of(word: bytes) -> list[bytes]:
    """The word itself, marked at its end, and its beginnings."""
    return [word + b"$", *(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))]


def head_of(mark: bytes) -> int:
    """The first four letters, fewer of a shorter word, as a number."""
    return int.from_bytes(mark[:-1][:4] if mark.endswith(b"$") else mark[:4], "little")


def marks(sample: DataFrame, weight: float) -> tuple[dict[bytes, float], float]:
    """Log ratio of each mark's rates in toxic and clean texts, and the share of toxic rows.

    A text counts a mark at most five times, so that repetitive texts do not decide.
    """

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            seen: dict[bytes, list[int]] = {}
            data, bounds = buffers(batch.column(0))
            data = LOW[data]
            starts, ends = letter_runs(data, bounds)
            raw, firsts = data.tobytes(), np.searchsorted(starts, bounds)
            for k, toxic in enumerate(batch.column(1).to_pylist()):
                own: Counter[bytes] = Counter()
                for word, n in Counter(raw[starts[i] : ends[i]] for i in range(firsts[k], firsts[k + 1])).items():
                    for part in parts_of(word):
                        own[part] += n
                own[b""] = int(firsts[k + 1] - firsts[k])
                for part, n in own.items():
                    have = seen.setdefault(part, [0, 0, 0])
                    have[toxic] += min(n, 5) if part else n
                    have[2] += toxic
            if seen:
                columns = [pa.array([x[i] for x in seen.values()], pa.int64()) for i in (1, 0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *columns], names=["mark", "toxic", "clean", "texts"])

    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_toxic = totals[0] or 0
    base = (n_toxic + 0.5) / (n_toxic + (totals[1] - n_toxic) * weight + 1)
    if not n_toxic:
        return {}, base
    counted = Table(ship(sample.select("text", "toxic")).mapInArrow(run, "mark binary, toxic long, clean long, texts long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("texts").alias("texts")).where("texts >= 4"), "marks")
    whole = counted.read().where(F.col("mark") == F.lit(bytearray())).first()
    if whole is None:
        return {}, base
    ratio = F.log((F.col("toxic") + 0.5) / (whole.toxic + 1.0) / ((F.col("clean") + 0.5) / (whole.clean + 1.0)))
    share = whole.toxic / (whole.toxic + whole.clean + 1.0)
    gain = F.col("toxic") * F.log(F.col("toxic") / ((F.col("toxic") + F.col("clean")) * share))
    best = counted.read().where(F.length("mark") > 0).withColumn("ratio", ratio).withColumn("gain", gain).where("ratio > 1 and gain > 12").orderBy(F.desc("gain"), "mark").limit(MARKS).collect()
    counted.drop()
    return {bytes(r.mark): float(r.ratio) for r in best}, base


def features(total: np.ndarray, top: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Inputs of the last step: summed and largest log ratios, the sum against the text's length, the length."""
    return np.column_stack((np.minimum(total, 60), top, total / np.sqrt(size + 10), np.log1p(size), np.ones(len(size))))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    w[-1] = math.log((weights[y == 1].sum() + 0.5) / (weights[y == 0].sum() + 0.5))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weights * (y - p)) - 0.1 * w * (np.arange(len(w)) < len(w) - 1)
        h = (x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Marks with their log ratios, the weights of the last step, and the character model."""

    def __init__(self, found: dict[bytes, float], base: float, characters: np.ndarray, last: np.ndarray | None = None):
        self.found, self.base, self.characters, self.last = found, base, characters, last
        self.heads = np.unique(np.array([head_of(m) for m in found], np.uint32))
        self.known: dict[str, float] = {}
        self.words: dict[bytes, float] = {}

    def ratio(self, word: bytes) -> float:
        if word not in self.words:
            if len(self.words) > HELD:
                self.words.clear()
            self.words[word] = max((self.found.get(p, 0.0) for p in parts_of(word)), default=0.0)
        return self.words[word]

    def disguised(self, token: bytes) -> float:
        """The highest ratio of the token's decodings and of its letters as they stand."""
        if token not in self.known:
            if len(self.known) > HELD:
                self.known.clear()
            readings = [w.encode() for w in decodings(token.decode(errors="ignore"), self.characters)]
            self.known[token] = max(self.ratio(w) for w in [*readings, *_RUN.findall(token.lower())])
        return self.known[token]

    def inputs(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Features of the rows in one buffer."""
        n = len(bounds) - 1
        total, top = np.zeros(n), np.zeros(n)
        lower = LOW[data]
        starts, ends = letter_runs(lower, bounds)
        size = np.diff(np.searchsorted(starts, bounds))
        if len(self.heads):
            hidden = suspects(data, bounds)
            if hidden:  # their letters do not count beside their decodings
                spans = np.array(sorted((a, b) for _, a, b, _ in hidden)).ravel()
                plain = np.searchsorted(spans, starts, "right") % 2 == 0
                starts, ends = starts[plain], ends[plain]
            head = lower[starts].astype(np.uint32)
            padded = np.append(lower, np.zeros(4, np.uint8))
            for k in (1, 2, 3):
                head |= np.where(starts + k < ends, padded[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
            near = np.flatnonzero(np.isin(head, self.heads))
            raw = lower.tobytes()
            found = [self.ratio(raw[a:b]) for a, b in zip(starts[near].tolist(), ends[near].tolist(), strict=True)]
            doc = np.searchsorted(bounds, starts[near], "right") - 1
            doc = np.append(doc, np.array([d for d, _, _, _ in hidden], np.int64))
            found = np.append(np.array(found, float), np.array([self.disguised(token) for _, _, _, token in hidden], float))
            np.add.at(total, doc, found)
            np.maximum.at(top, doc, found)
        return features(total, top, size)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.last is None:
            return np.full(len(bounds) - 1, self.base)
        return 1 / (1 + np.exp(-np.clip(self.inputs(data, bounds) @ self.last, -30, 30)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of rows (doc_id, text)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data, bounds = buffers(batch.column(1))
                got, i = np.empty(batch.num_rows), 0
                while i < batch.num_rows:  # about 2 MB of text at once
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 21), "right")) - 1)
                    got[i:j] = model.score(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    i = j
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(got, 9))], names=["doc_id", "score"])

    return ship(docs).mapInArrow(run, "doc_id long, score double")


def fitted_inputs(sample: DataFrame, model: Model) -> np.ndarray:
    """Label and features of the sample's rows (at most FIT_TOXIC + FIT_CLEAN)."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                x = model.inputs(*buffers(piece.column(0)))
                yield pa.RecordBatch.from_arrays([piece.column(1), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["y", "a", "b", "c", "d", "e"])

    rows = ship(sample.select("text", "toxic")).mapInArrow(run, "y int, a double, b double, c double, d double, e double").collect()
    return np.array(sorted(tuple(map(float, r)) for r in rows)).reshape(len(rows), -1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from (doc_id, text) and labels (doc_id, toxic), held-out rows left out."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    sample = docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("text", "toxic").dropDuplicates(["text"])
    sample = Table(sample, "toxic-sample")
    weight = counts.get(0, 0) / max(1, min(counts.get(0, 0), FIT_CLEAN)) / max(1.0, counts.get(1, 0) / FIT_TOXIC)
    found, base = marks(sample.read(), max(weight, 1e-9))
    characters = log_model(trigram_counts(docs))
    model = Model(found, base, characters)
    if found:
        rows = fitted_inputs(sample.read(), model)
        y, x = rows[:, 0], rows[:, 1:]
        if 0 < y.sum() < len(y):
            model.last = logistic(x, y, np.where(y == 1, 1.0, weight))
    sample.drop()
    return model


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    source = id_text(docs, id_col, text_col)
    scored = scores(source, fit(source, labels.select("doc_id", "toxic")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    model = fit(id_text(docs, id_col, text_col), labels.select("doc_id", "toxic"))
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data, bounds = buffers(batch.column(place))
                keep, i = np.empty(batch.num_rows, bool), 0
                while i < batch.num_rows:
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 21), "right")) - 1)
                    keep[i:j] = model.score(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) < THRESHOLD
                    i = j
                yield batch.filter(pa.array(keep)).rename_columns(names)

    return ship(docs).mapInArrow(run, docs.schema)


def op6_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
