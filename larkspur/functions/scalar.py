"""The dialect's twelve scalar functions and its arithmetic, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\u000b\u000c"


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def length(s: Column) -> Column:
    """Bytes, as a bigint."""
    return F.octet_length(s).cast("long")


def trim(s: Column) -> Column:
    """Strips all ASCII white space, not only spaces."""
    return F.btrim(s, F.lit(BLANKS))


def substr(s: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """1-based; 0 acts as 1; a negative start counts from the end and stops at the first character."""
    start = F.lit(start) if isinstance(start, int) else start
    at = F.when(start < 0, F.greatest(start, -F.length(s))).when(start == 0, F.lit(1)).otherwise(start).cast("int")
    rest = F.length(s) if count is None else (F.lit(count) if isinstance(count, int) else count)
    return F.substr(s, at, F.greatest(rest, F.lit(0)).cast("int"))


def absolute(x: Column) -> Column:
    return F.abs(x)


def rounded(x: Column, digits: int | None = None) -> Column:
    """Half away from zero; an integer without digits."""
    return F.round(x).cast("long") if digits is None else F.round(x, digits).cast("double")


def ceiling(x: Column) -> Column:
    return F.ceil(x).cast("long")


def floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def coalesce(*xs: Column) -> Column:
    return F.coalesce(*xs)


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def divide(a: Column, b: Column, integral: bool) -> Column:
    """NULL on division by zero; integers divide to an integer, towards zero."""
    divisor = F.nullif(b, F.lit(0))
    return F.call_function("div", a, divisor) if integral else a / divisor


def modulo(a: Column, b: Column) -> Column:
    """Sign of the dividend; NULL on zero."""
    return a % F.nullif(b, F.lit(0))


def like(s: Column, pattern: str) -> Column:
    """``%``, ``_`` and ``\\`` as escape; an escape before an ordinary character is that character."""
    return s.like(normal_pattern(pattern))


def normal_pattern(pattern: str) -> str:
    """Spark refuses an escape before an ordinary character or at the end; the dialect takes both literally."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                out.append("\\\\")
            elif pattern[i + 1] in "%_\\":
                out.append(c + pattern[i + 1])
            else:
                out.append(pattern[i + 1])
            i += 2
        else:
            out.append(c)
            i += 1
    return "".join(out)
