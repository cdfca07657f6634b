"""What makes a match a finding: once per position, numbered, fingerprinted, redacted, digested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exactly_once(rows: DataFrame, scope: list[str], order: list[str], marker: str) -> DataFrame:
    """Rows whose marker exceeds all markers of the scope before them, in scan order (a high-water, not a distinct)."""
    before = W.partitionBy(*scope).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    high = rows.withColumn("__high", F.max(marker).over(before))
    return high.where(F.col("__high").isNull() | (F.col(marker) > F.col("__high"))).drop("__high")


def attempt_ordinal(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("attempt_ordinal", F.row_number().over(W.partitionBy(*scope).orderBy(*order)).cast("long"))


def fingerprint(material: Column, salt: str) -> Column:
    """Salted SHA-256: the same material gives the same fingerprint within a salt, and can't be read from it."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\x1f"), material), 256)


def masked(material: Column) -> Column:
    """First two characters and the length."""
    return F.concat(F.substring(material, 1, 2), F.lit("...("), F.length(material).cast("string"), F.lit(")"))


def apply_policy(findings: DataFrame, *, policy: str = "redacted", salt: str = "") -> DataFrame:
    """Replace ``material`` by material_fingerprint, material_length and material_preview; ``raw`` keeps it too."""
    if policy not in ("redacted", "raw"):
        raise ValueError(f"unknown material policy: {policy}")
    out = findings.withColumns(
        {"material_fingerprint": fingerprint(F.col("material"), salt), "material_length": F.length("material"), "material_preview": masked(F.col("material"))}
    )
    return out if policy == "raw" else out.drop("material")


def finding_id(*columns: str) -> Column:
    """A deterministic id from a natural key."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def json_line(rows: DataFrame) -> Column:
    """A row as one line of JSON, columns by name; bytes as their encoding and hexadecimal digits, which text would garble."""
    shown = lambda c, kind: F.struct(F.lit("hex").alias("encoding"), F.lower(F.hex(c)).alias("data")) if kind == "binary" else F.col(c)
    return F.to_json(F.struct(*(shown(c, kind).alias(c) for c, kind in sorted(rows.dtypes))))


def digest(rows: DataFrame, keys: list[str], line: Column, order: list[str]) -> DataFrame:
    """keys, lines and digest: SHA-256 over each key's lines in a canonical order.

    Lines are hashed one by one first, so a key's state is 64 characters for each line.
    """
    out = rows.select(*keys, F.struct(*order, F.sha2(line, 256).alias("__line")).alias("__at"))
    return out.groupBy(*keys).agg(F.count("*").alias("lines"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("__at")), lambda x: x["__line"]), "\n"), 256).alias("digest"))
