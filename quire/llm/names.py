"""Names for helper columns that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(frame: DataFrame, *wanted: str) -> tuple[str, ...]:
    """For each wanted name one like it that the frame lacks, in any case of letters."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in wanted:
        made = f"__{name}"
        while made.lower() in taken:
            made += "_"
        taken.add(made.lower())
        out.append(made)
    return tuple(out)
