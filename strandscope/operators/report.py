"""Read queries over findings: tail, keyset pages, search, most recently seen keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tail_page(rows: DataFrame, sequence: str, limit: int) -> DataFrame:
    """The last ``limit`` rows; Spark keeps that many a task and merges them."""
    return rows.orderBy(F.desc(sequence)).limit(limit)


def keyset_page(rows: DataFrame, sequence: str, cursor: int, limit: int) -> DataFrame:
    """The first ``limit`` rows after the cursor; the condition reaches the scan."""
    return rows.where(F.col(sequence) > cursor).orderBy(sequence).limit(limit)


def search(rows: DataFrame, column: str, needle: str, **equals: str) -> DataFrame:
    """Rows that contain ``needle`` (case doesn't matter) and have the given values."""
    for name, value in equals.items():
        rows = rows.where(F.col(name) == value)
    return rows.where(F.contains(F.lower(column), F.lit(needle.lower())))


def most_recent_keys(rows: DataFrame, keys: list[str], seen: str, limit: int) -> DataFrame:
    """Keys that a store of ``limit`` would still hold: keys and last_seen, the latest first."""
    return rows.groupBy(*keys).agg(F.max(seen).alias("last_seen")).orderBy(F.desc("last_seen"), *keys).limit(limit)
