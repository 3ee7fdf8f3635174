"""Relations as text tables for people."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(frame: DataFrame, most: int = 1000) -> str:
    """Centred columns of a frame of text; at most `most` rows, with a line that says if there are more."""
    rows = [["" if x is None else str(x) for x in r] for r in frame.take(most + 1)]
    more, rows = len(rows) > most, rows[:most]
    width = [max(map(len, column)) for column in zip(frame.columns, *rows)]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    shown = ["|" + "|".join(f" {x:^{w}} " for x, w in zip(r, width)) + "|" for r in [frame.columns, *rows]]
    return "\n".join([line, shown[0], line, *shown[1:], line] + ["more rows follow"] * more)
