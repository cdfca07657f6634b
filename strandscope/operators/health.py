"""Counters, quality gates and the verdict of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Counters that never make a run incomplete, whatever their value.
BENIGN = ("http_framed_requests", "retransmitted_bytes", "flows_expired", "packets_decoded", "findings")


def merge_counters(counters: DataFrame) -> DataFrame:
    """name and value: sums over workers. An unknown (null) counter stays unknown only if no worker knows it."""
    return counters.groupBy("name").agg(F.sum("value").alias("value"))


def peaks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(value).alias("peak"))


def error_gate(rows: DataFrame, keys: list[str], is_error: Column, *, least: int = 100, ratio: float = 0.10) -> DataFrame:
    """Keys with at least ``least`` errors that are at least ``ratio`` of the attempts: keys, attempts, errors."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(is_error).alias("errors"))
    return sums.where((F.col("errors") >= least) & (F.col("errors") >= ratio * F.col("attempts")))


def burst_breaker(rows: DataFrame, keys: list[str], seconds: Column, *, span: int, limit: int) -> DataFrame:
    """Rows at which ``limit`` or more rows of the key lie within the last ``span`` seconds: all columns and in_span."""
    window = W.partitionBy(*keys).orderBy("__s").rangeBetween(-span, 0)
    return rows.withColumn("__s", seconds).withColumn("in_span", F.count("*").over(window)).drop("__s").where(F.col("in_span") >= limit)


def delivery_issue(received: Column, dropped: Column, captured: Column, *, offline: Column) -> Column:
    """Reason if a live capture's own statistics don't add up, or aren't known; null if there is no issue."""
    return F.when(offline, F.lit(None).cast("string")).when(received.isNull() | dropped.isNull(), "capture_statistics_unknown").when(dropped > 0, "capture_dropped_packets").when(
        received - dropped != captured, "capture_delivery_mismatch"
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose counts ``n`` differ between both sides, a side without the key counting 0: keys, left_n, right_n."""
    both = left.withColumnRenamed("n", "left_n").join(right.withColumnRenamed("n", "right_n"), keys, "full_outer").fillna(0, ["left_n", "right_n"])
    return both.where("left_n <> right_n").select(*keys, "left_n", "right_n")


def verdict(counters: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """One row: verdict (complete or incomplete) and the sorted distinct reasons. Any loss counter above 0 is a reason."""
    lost = counters.where((F.col("value") > 0) & ~F.col("name").isin(*BENIGN)).select(F.concat("name", F.lit("="), F.col("value").cast("string")).alias("reason"))
    lost = lost.unionByName(reasons.select("reason").where("reason is not null")) if reasons is not None else lost
    out = lost.agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return out.select(F.when(F.size("reasons") == 0, "complete").otherwise("incomplete").alias("verdict"), "reasons")
