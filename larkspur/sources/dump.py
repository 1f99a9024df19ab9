"""Text output: aligned tables for the shell, and a dump of a whole database."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shown(value) -> str:
    return "NULL" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value)


def table_text(df: DataFrame, most: int | None = 50) -> str:
    """An aligned table; at most ``most`` rows come to the driver, one more to see that there are more."""
    rows = df.limit(most + 1).collect() if most is not None else df.toLocalIterator()
    cells = [[shown(v) for v in r] for r in rows]
    more = most is not None and len(cells) > most
    cells = [list(df.columns), *(cells[:most] if more else cells)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    lines.insert(1, "-+-".join("-" * w for w in widths))
    return "\n".join([*lines, "..."] if more else lines)


def dump(session, path: str) -> None:
    """Every table of the session's database, table by table through an iterator."""
    with open(path, "w", encoding="utf-8") as out:
        for name in session.catalog["tables"]:
            df = session.rows(name)
            out.write(f"{name}\n{' | '.join(df.columns)}\n")
            for row in df.toLocalIterator():
                out.write(" | ".join(shown(v) for v in row) + "\n")
            out.write("\n")
