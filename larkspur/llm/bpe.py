"""Operator 10, BPE encoding and decoding through a table of distinct words.

Words are split at the single spaces that the byte-level pre-tokenizer always splits at (between two characters
that are not white space), so a word encodes alone as it does within its text. Each distinct word is encoded once
and the ids are joined back by position; ids decode through a join with the table of pieces by id.

Two forms give the same rows. ``encode`` keeps the table of distinct words in each Python worker, bounded and kept
from task to task, and joins by position within the text: nothing is shuffled. ``encode_by_join`` has the table as a
DataFrame of the whole corpus and joins by Spark; it moves every word of every text (about 30 bytes each, 4 GB for
0.86 GB of text), which is beyond the disk that the check allows, so the query uses the first.

Defined results: null and empty texts have no tokens and decode to ''; the special token's string in a text becomes
the special token, as the library does; repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._frames import documents, id_text, map_arrow
from larkspur.llm._text import buffers

#: Bytes of distinct words and ids that a worker keeps, with ENTRY for what Python adds to each; when full, the table starts anew.
TABLE_BYTES, ENTRY = 96 << 20, 220
#: Longer words (texts without spaces are one word) are encoded where they stand and not kept.
LONG = 256
CHUNK = 1 << 20
_WHITE = rb"(?:[\t-\r\x1c- ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_BROKEN = re.compile(b" " + _WHITE + b"|" + _WHITE + b" ")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_HELD: dict[str, Codec] = {}


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One tokenizer file: its table of distinct words and its pieces by id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.first: dict[bytes, bytes] = {}
        self.later: dict[bytes, bytes] = {}
        self.held = 0
        pieces = piece_table(path)
        size = max(pieces) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, p in pieces.items():
            self.lengths[i] = len(p)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(pieces[i] for i in sorted(pieces)), np.uint8)

    @staticmethod
    def of(path: str) -> Codec:
        if path not in _HELD:
            _HELD[path] = Codec(path)
        return _HELD[path]

    def learn(self, table: dict[bytes, bytes], new: list[bytes], lead: str) -> list[bytes]:
        """Adds words to a table; returns those that are too long to stay."""
        for word, got in zip(new, self.tokenizer.encode_batch([lead + w.decode() for w in new], add_special_tokens=False), strict=True):
            table[word] = ids = np.array(got.ids, "<u4").tobytes()
            if len(word) <= LONG:
                self.held += ENTRY + len(word) + len(ids)
        return [w for w in new if len(w) > LONG]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > TABLE_BYTES:
            self.later.clear()
            self.first.clear()
            self.held = 0
        parts = [split_words(t) for t in texts]
        first, later = self.first, self.later
        passing = [(table, w) for table, new, lead in ((later, {w for p in parts for w in p[1:] if w not in later}, " "), (first, {p[0] for p in parts if p[0] not in first}, "")) if new for w in self.learn(table, list(new), lead)]
        out = [first[p[0]] + b"".join([later[w] for w in p[1:]]) for p in parts]
        for table, w in passing:
            del table[w]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces, end to end, and the end of each."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.pool[at], ends


def piece_table(path: str) -> dict[int, bytes]:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    back = _bytes_of_characters()
    pieces = {i: bytes(back[c] for c in token) for token, i in data["model"]["vocab"].items()}
    return pieces | {t["id"]: t["content"].encode() for t in data["added_tokens"]}


def split_words(text: bytes) -> list[bytes]:
    """The first word, and the later ones without the space before them."""
    if _BROKEN.search(text) is None:
        return text.split(b" ")
    return [w.encode() for w in _BETWEEN.split(text.decode())]


def chunks(bounds: np.ndarray):
    """Ranges of rows of about CHUNK bytes."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def encoded(batch: pa.RecordBatch, path: str):
    """For each row: ids as bytes and the decoded bytes."""
    codec = Codec.of(path)
    data, bounds = buffers(batch.column(1))
    raw = data.tobytes()
    for i, j in chunks(bounds):
        rows = codec.encode([raw[bounds[k] : bounds[k + 1]] for k in range(i, j)])
        ids = np.frombuffer(b"".join(rows), "<u4")
        back, ends = codec.decode(ids)
        stops = np.cumsum([len(r) // 4 for r in rows])
        cuts = np.append(0, np.append(0, ends)[stops])
        back = back.tobytes()
        for k, r in enumerate(rows):
            yield r, back[cuts[k] : cuts[k + 1]]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row."""

    def step(batch: pa.RecordBatch):
        got = list(encoded(batch, path))
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) // 4 for r, _ in got])).astype(np.int32)), pa.array(np.frombuffer(b"".join(r for r, _ in got), "<u4").astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([b.decode() for _, b in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def step(batch: pa.RecordBatch):
        n, a, b = [], [], []
        for ids, back in encoded(batch, path):
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(back).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_by_join(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), by joins with the corpus's table of distinct words and the table of pieces."""
    rows = id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))

    def split(batch: pa.RecordBatch):
        data, bounds = buffers(batch.column(1))
        raw = data.tobytes()
        row = batch.column(2).to_numpy(zero_copy_only=False)
        parts = [split_words(raw[bounds[k] : bounds[k + 1]]) for k in range(batch.num_rows)]
        words = [(b" " if at else b"") + w for p in parts for at, w in enumerate(p)]
        size = np.array([len(p) for p in parts])
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(row, size)), pa.array(at.astype(np.int32)), pa.array([w.decode() for w in words], pa.string())], names=["row", "at", "word"])

    def learn(batch: pa.RecordBatch):
        got = Codec.of(path).tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g.ids for g in got], pa.list_(pa.int32()))], names=["word", "ids"])

    placed = map_arrow(rows.dropDuplicates(["row"]), split, "row long, at int, word string")
    table = map_arrow(placed.select("word").distinct(), learn, "word string, ids array<int>")
    ids = placed.join(table, "word").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    ids = ids.select("row", F.flatten(F.col("parts.ids")).alias("ids"))
    pieces = docs.sparkSession.createDataFrame([(i, bytearray(p)) for i, p in piece_table(path).items()], "id int, piece binary")
    back = ids.select("row", F.posexplode("ids").alias("at", "id")).join(pieces, "id").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("parts"))
    back = back.select("row", F.decode(F.unhex(F.array_join(F.col("parts.piece"), "")), "UTF-8").alias("decoded"))
    return rows.join(ids, "row").join(back, "row", "left").select("doc_id", "ids", F.coalesce("decoded", F.lit("")).alias("decoded"))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), default_path())
