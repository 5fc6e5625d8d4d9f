"""Column names that a caller's table does not use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
