"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Lower-cases A-Z in UTF-8 bytes and leaves all else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
