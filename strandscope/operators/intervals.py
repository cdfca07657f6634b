"""Interval algebra: stream offsets, overlap trimming, gaps, completeness and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream_offsets(rows: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """Add stream_start and stream_stop: running sums of lengths along each key."""
    total = F.sum(length).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("stream_stop", total).withColumn("stream_start", F.col("stream_stop") - F.col(length))


def trim_retransmits(rows: DataFrame, keys: list[str], start: str, stop: str, tie: list[str]) -> DataFrame:
    """Add fresh_start and gap: what a range adds to the ranges that start before it, and the hole in front of it.

    ``fresh_start`` equals the stop where a range is all repetition. Bytes of a
    range that starts earlier win, ties going to the first by ``tie``.
    """
    before = W.partitionBy(*keys).orderBy(start, *tie).rowsBetween(W.unboundedPreceding, -1)
    reached = F.max(stop).over(before)
    return rows.withColumn("fresh_start", F.least(F.col(stop), F.greatest(F.col(start), F.coalesce(reached, F.col(start))))).withColumn("gap", F.greatest(F.col(start) - F.coalesce(reached, F.col(start)), F.lit(0)))


def complete_groups(rows: DataFrame, keys: list[str], number: str, *, first: int = 1) -> DataFrame:
    """keys, pieces and complete: whether the numbers run from ``first`` without a hole. Aggregates only; no sort."""
    return rows.groupBy(*keys).agg(F.count_distinct(number).alias("pieces"), F.max(number).alias("last"), F.min(number).alias("least")).select(
        *keys, "pieces", ((F.col("least") == first) & (F.col("last") - F.col("least") + 1 == F.col("pieces"))).alias("complete")
    )


def _buckets(start: Column, stop: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(stop, start + 1) - 1) / width))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], *, width: int, how: str = "inner") -> DataFrame:
    """Rows of ``left`` and ``right`` (both with ``start`` and ``stop``, half open) that overlap, within equal ``keys``.

    Ranges are cut into buckets of ``width`` and joined on them, so the join is
    an equi-join. A pair is formed in the bucket where the later one starts,
    and so once. ``how``: inner (right's columns prefixed ``r_``), left_semi or
    left_anti, which pair each different range once. Use a width near the usual
    length of a range. Keys aren't null.
    """
    if how != "inner":
        ranges = [side.select(*keys, "start", "stop").distinct() for side in (left, right)]
        hit = range_join(*ranges, keys, width=width).select(*keys, "start", "stop").distinct()
        return left.join(hit, [*keys, "start", "stop"], how)
    a = left.withColumn("__bucket", F.explode(_buckets(F.col("start"), F.col("stop"), width)))
    others = [c for c in right.columns if c not in keys]
    b = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in others)).withColumn("__bucket", F.explode(_buckets(F.col("r_start"), F.col("r_stop"), width)))
    met = (F.col("start") < F.col("r_stop")) & (F.col("r_start") < F.col("stop")) & (F.col("__bucket") == F.floor(F.greatest("start", "r_start") / width))
    return a.join(b, [*keys, "__bucket"]).where(met).drop("__bucket")


def met_counts(left: DataFrame, right: DataFrame, keys: list[str], value: str, length: int) -> DataFrame:
    """keys, start, met and met_values of each different range of ``left`` that any of ``right`` overlaps: how many, and how many values of a column.

    For ranges of whole numbers, ``left``'s all of one ``length``. No pair is formed: a range of ``right`` is met by ``left``'s
    that start in one stretch, so sums over the stretches' ends count ranges, and sums over what each adds to its value's
    earlier stretches count values. Work and disk grow with the rows, not with the pairs.
    """
    stretch = right.select(*keys, value, (F.col("start") - length + 1).alias("from"), F.col("stop").alias("to")).where(F.col("from") < F.col("to")).dropna(subset=keys)
    fresh = trim_retransmits(stretch, [*keys, value], "from", "to", ["to"])
    first = (F.col(value).isNotNull() & (F.col("fresh_start") < F.col("to"))).cast("long")
    ends = F.array(*(F.struct(at.alias("at"), n.alias("n"), v.alias("v")) for at, n, v in (
        (F.col("from"), F.lit(1).cast("long"), F.lit(0).cast("long")), (F.col("fresh_start"), F.lit(0).cast("long"), first), (F.col("to"), F.lit(-1).cast("long"), -first),
    )))
    steps = fresh.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.n").alias("n"), F.sum("e.v").alias("v"))
    asked = left.select(*keys, "start").dropna().distinct().select("*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("v"), F.lit(True).alias("asked"))
    every = asked.unionByName(steps, allowMissingColumns=True).groupBy(*keys, "start").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("asked").alias("asked"))
    so_far = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = every.withColumns({"met": F.sum("n").over(so_far), "met_values": F.sum("v").over(so_far)})
    return sums.where("asked and met > 0").select(*keys, "start", "met", "met_values")


def covered(left: DataFrame, right: DataFrame, keys: list[str], *, width: int) -> DataFrame:
    """``left`` with covered_length: how much of each range the union of ``right``'s ranges covers."""
    pairs = range_join(left.select(*keys, "start", "stop").distinct(), right.select(*keys, "start", "stop"), keys, width=width)
    pairs = pairs.select(*keys, "start", "stop", F.greatest("start", "r_start").alias("from"), F.least("stop", "r_stop").alias("to"))
    pairs = trim_retransmits(pairs, [*keys, "start", "stop"], "from", "to", ["to"])
    sums = pairs.groupBy(*keys, "start", "stop").agg(F.sum(F.col("to") - F.col("fresh_start")).alias("covered_length"))
    return left.join(sums, [*keys, "start", "stop"], "left").fillna(0, ["covered_length"])
