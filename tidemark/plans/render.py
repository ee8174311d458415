"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cell(value) -> str:
    """NULL for null, (empty) for the empty string, lower-case booleans."""
    if value is None:
        return "NULL"
    if value is True or value is False:
        return str(value).lower()
    text = str(value)
    return text if text else "(empty)"


def rows_text(df: DataFrame) -> list[str]:
    """One line per row, cells separated by blanks."""
    return [" ".join(cell(v) for v in r) for r in df.collect()]


def table_text(df: DataFrame, limit: int = 1_000) -> str:
    """A bordered table of at most ``limit`` rows, for display; a line below says if there are more."""
    found = df.limit(limit + 1).collect()
    rows = [[cell(v) for v in r] for r in found[:limit]]
    widths = [max([len(c), *[len(r[i]) for r in rows]]) for i, c in enumerate(df.columns)]
    edge = "+" + "+".join("-" * (w + 2) for w in widths) + "+"

    def line(cells) -> str:
        return "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths)) + "|"

    more = [f"(the first {limit} rows; there are more)"] if len(found) > limit else []
    return "\n".join([edge, line(df.columns), edge, *[line(r) for r in rows], edge, *more])
