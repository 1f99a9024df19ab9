"""Operator 3, quality rules: line-first cleaning, DataFrame functions only.

Each line is judged by itself. It fails

- on punctuation, if it does not end a sentence (``TERMINAL``, closing quotes and brackets aside) or a tenth of its
  characters or more are of ``#*$%&|<>``: menus, headings, tag clouds and cut-off pieces;
- as navigation, if it has three bars or more, whatever its end;
- as boilerplate, if it has a licence, cookie or sharing phrase or is a bare link.

Failing lines and lines equal to an earlier one go; a document is kept if what is left is ``1 - max_loss`` of its
characters or more. The base rules (word count and the share of words in repeated 8-word windows) reject before that.

Everything is one projection over the row: no shuffle, no Python. Words are hashed once, and the hashes of pairs, of
four and of eight words follow from these, so a window costs three hashes of two longs. Repeated windows are found by
sorting the windows' hashes with their positions, only in texts where some repeat. Rules for symbols, phrases and links
run over the lines of those texts alone that have one. Long documents cost n log n in their words.

Defined results: null and empty texts have no words, fail the base rule (fewer than 20 words) and are not kept;
repeated rows get equal results; extra columns are not read by the query and pass through ``clean_lines``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._frames import documents, fresh

BLANK = " \t\n\u000b\f\r"
SPACES = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = ("licensed under", "released under", "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "click here", "read more", "sign up", "subscribe", "copyright", "share this", "share on")
#: Ends of sentences, and what may close after them.
TERMINAL, CLOSING = ".!?…。！？؟।:;", ")]\"'»”’"
LINKS = ("http://", "https://", "www.")
MIN_WORDS, WINDOW, MAX_REPEAT, MAX_LOSS = 20, 8, 30, 0.5


def without(text: Column, characters: str) -> Column:
    """Byte-wise replacements: one pass for each character, without a lookup for each character of the text."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def has_word(line: Column) -> Column:
    return F.length(F.ltrim(line, F.lit(BLANK))) > 0


def boilerplate(text: Column) -> Column:
    """Whether one of the phrases stands in the text, whatever its case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(x)) for x in BOILERPLATE])


def ends_sentence(line: Column) -> Column:
    end = F.rtrim(line, F.lit(BLANK + CLOSING))
    return reduce(lambda a, b: a | b, [F.endswith(end, F.lit(c)) for c in TERMINAL])


def striking(text: Column) -> Column:
    """Whether a text has anything that the rules beside the sentence's end look for."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in [*SYMBOLS, *LINKS]]) | boilerplate(text)


def line_fails(line: Column) -> Column:
    """One line, by itself."""
    bare = without(line, BLANK)
    symbols = F.length(bare) - F.length(without(bare, SYMBOLS))
    bars = F.length(line) - F.length(without(line, "|"))
    return ~ends_sentence(line) | (symbols * 10 >= F.length(bare)) | (bars >= 3) | boilerplate(line) | line.rlike("^\\s*(https?://|www\\.)\\S+\\s*$")


def repeated_words(hashes: Column, window: int) -> Column:
    """Words in windows that occur twice or more, from the array of the windows' hashes."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a window repeats if a neighbour in hash order equals it
    paired = F.zip_with(ordered, F.concat(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    linked = F.filter(paired, lambda p: p["a"]["h"] == p["b"]["h"])
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(linked, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    nexts = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(2147483647)))
    return F.aggregate(F.zip_with(starts, nexts, lambda a, b: F.least(b - a, F.lit(window))), F.lit(0), lambda total, x: total + x)


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """The documents with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, left_chars."""
    taken = list(docs.columns)
    plain, words, lines, distinct, good, bare, strikes = (fresh(f"q_{x}", taken) for x in ("text", "words", "lines", "distinct", "good", "bare", "strikes"))
    df = docs.withColumn(plain, F.coalesce(text, F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(F.col(plain), SPACES), "")).withColumn(lines, F.filter(F.split(F.col(plain), "\n"), has_word))
    df, hashes = window_hashes(df, words)
    df = df.withColumn(bare, without(F.col(plain), BLANK)).withColumn(distinct, F.array_distinct(F.col(lines))).withColumn(strikes, striking(F.col(plain)))
    # the lambdas see lines only: what they took from the text would be computed anew for each line
    df = df.withColumn(good, F.when(F.col(strikes), F.filter(F.col(distinct), lambda x: ~line_fails(x))).otherwise(F.filter(F.col(distinct), ends_sentence)))
    left = F.when(F.size(good) == F.size(lines), F.length(bare)).otherwise(F.length(without(F.array_join(F.col(good), ""), BLANK)))
    return df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": F.when(F.col(strikes), F.length(bare) - F.length(without(F.col(bare), SYMBOLS))).otherwise(F.lit(0)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(distinct)).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct(F.col(hashes))) == F.size(hashes), F.lit(0)).otherwise(repeated_words(F.col(hashes), WINDOW)).cast("long"),
            "left_chars": left.cast("long"),
        }
    ).drop(plain, words, lines, distinct, good, bare, strikes, hashes)


def window_hashes(df: DataFrame, words: str) -> tuple[DataFrame, str]:
    """Adds a column with a 64-bit hash of each window of WINDOW words, by doubling; and the column's name."""
    name = fresh("q_hashes", df.columns)
    df = df.withColumn(name, F.transform(F.col(words), lambda w: F.xxhash64(w)))
    step = 1
    while step < WINDOW:
        before, name = name, fresh(f"q_hashes{step}", df.columns)
        shorter = F.greatest(F.size(before) - step, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(F.col(before), 1, shorter), F.slice(F.col(before), step + 1, shorter), lambda a, b: F.xxhash64(a, b))).drop(before)
        step *= 2
    return df, name


def judged(df: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("left_chars") >= (1 - max_loss) * F.col("word_chars")))


def clean_lines(docs: DataFrame, text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """The kept documents, all their columns, without the failing and the repeated lines. Blank lines stay out."""
    scratch = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    place = docs.columns.index(text_col)
    kept = judged(measured(scratch, F.col(f"c{place}")), max_loss).where("kept")
    lines = F.array_distinct(F.filter(F.split(F.col(f"c{place}"), "\n"), has_word))
    cleaned = F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n")
    return kept.select(*[(cleaned if i == place else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judged(measured(docs, F.col("text"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_chars", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM p),
r AS (SELECT doc_id, h FROM g GROUP BY doc_id, h HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT g.doc_id, g.i, unnest(range(0, 8)) AS k FROM g JOIN r USING (doc_id, h)) GROUP BY doc_id),
u AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(l) AS x FROM d)),
b AS (SELECT doc_id, x, regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') AS y FROM u),
k AS (SELECT doc_id, sum(length(y)) AS n FROM b WHERE NOT (
        NOT regexp_matches(x, '[.!?…。！？؟।:;][)\]"''»”’\x20\x09-\x0D]*$')
        OR length(regexp_replace(y, '[^#*$%&|<>]', '', 'g')) * 10 >= length(y) OR length(regexp_replace(x, '[^|]', '', 'g')) >= 3
        OR regexp_matches(lower(x), 'licensed under|released under|all rights reserved|cookie policy|accept cookies|privacy policy|terms of (use|service)|click here|read more|sign up|subscribe|copyright|share (this|on)')
        OR regexp_matches(x, '^\s*(https?://|www\.)\S+\s*$')) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(bare, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(k.n, 0) AS BIGINT) AS left_chars
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 2 * left_chars >= word_chars AS kept FROM f
"""
