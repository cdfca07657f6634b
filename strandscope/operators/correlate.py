"""Correlations between events of a flow: as-of pairing, carried context, multi-step exchanges, companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_pair(rows: DataFrame, keys: list[str], order: list[str], is_left: Column, is_right: Column, carried: list[str], *, prefix: str = "prior_") -> DataFrame:
    """Rows that are ``is_left``, each with the columns of the latest earlier row of its key that is ``is_right``.

    One sort of each key instead of a join; unmatched rows have nulls.
    """
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    held = F.last(F.when(is_right, F.struct(*carried)), ignorenulls=True).over(before)
    out = rows.withColumn("__prior", held).withColumn("__left", is_left).where("__left")
    return out.select(*rows.columns, *(F.col(f"__prior.{c}").alias(prefix + c) for c in carried))


def pair_once(rows: DataFrame, keys: list[str], order: list[str], is_challenge: Column, is_response: Column, carried: list[str], *, prefix: str = "challenge_") -> DataFrame:
    """As ``asof_pair``, but a challenge answers only the first response after it; later ones stay unmatched."""
    marked = rows.withColumn("__challenge", is_challenge).withColumn("__response", is_response)
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    turn = marked.withColumn("__turn", F.sum(F.col("__challenge").cast("long")).over(so_far))
    inside = W.partitionBy(*keys, "__turn").orderBy(*order)
    nth = F.sum(F.col("__response").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    held = F.first(F.when(F.col("__challenge"), F.struct(*carried)), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = turn.withColumn("__nth", nth).withColumn("__held", held).where("__response")
    return out.select(*rows.columns, *(F.when((F.col("__nth") == 1) & (F.col("__turn") > 0), F.col(f"__held.{c}")).alias(prefix + c) for c in carried))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], is_source: Column, value: str, name: str) -> DataFrame:
    """Add the latest ``value`` of a source row before (or at) each row of the key; it isn't used up."""
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(so_far))


def multi_step(rows: DataFrame, keys: list[str], order: list[str], steps: list[Column], carried: str) -> DataFrame:
    """keys and step_1, step_2, ...: ``carried`` of consecutive rows that meet the steps' conditions in turn."""
    window = W.partitionBy(*keys).orderBy(*order)
    for n, condition in enumerate(steps, 1):
        rows = rows.withColumn(f"__met_{n}", condition)
    met = F.lit(True)
    for n in range(1, len(steps) + 1):
        met = met & F.coalesce(F.lead(f"__met_{n}", n - 1).over(window), F.lit(False))
    out = rows.withColumn("__all", met).withColumns({f"step_{n}": F.lead(carried, n - 1).over(window) for n in range(1, len(steps) + 1)})
    return out.where("__all").select(*keys, *order, *(f"step_{n}" for n in range(1, len(steps) + 1)))


def sole_companion(rows: DataFrame, keys: list[str], role: str, value: str, strong: str, weak: str) -> DataFrame:
    """keys, companions and companion: the value of the only strong identity; of the only weak one if there is no strong one; else null."""
    is_strong, is_weak = F.col(role) == strong, F.col(role) == weak
    out = rows.groupBy(*keys).agg(
        F.count_if(is_strong).alias("n_strong"), F.count_if(is_weak).alias("n_weak"), F.max(F.when(is_strong, F.col(value))).alias("strong_value"), F.max(F.when(is_weak, F.col(value))).alias("weak_value")
    )
    chosen = F.when(F.col("n_strong") > 0, F.col("n_strong")).otherwise(F.col("n_weak"))
    picked = F.when(F.col("n_strong") == 1, F.col("strong_value")).when((F.col("n_strong") == 0) & (F.col("n_weak") == 1), F.col("weak_value"))
    return out.select(*keys, chosen.alias("companions"), picked.alias("companion"))
