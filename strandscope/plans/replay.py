"""From capture files to findings, counters and a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import detect_stream, emit, health, packets
from ..operators.flow import PacketFilter
from ..sources import capture


@dataclass(frozen=True)
class Replay:
    """Lazy frames of a run.

    Give ``scratch`` a shared folder to parse every capture once, and to
    reassemble flows of more than ``max_flow_bytes`` in bounded memory; without
    it, each action reads captures again and holds a flow whole.
    """

    findings: DataFrame
    counters: DataFrame
    verdict: DataFrame
    chunks: DataFrame
    reasons: DataFrame


def replay_packets(rows: DataFrame, settings: Settings | None = None, scratch: str | None = None, statistics: DataFrame | None = None, wanted: PacketFilter | None = None) -> Replay:
    """``statistics`` are of ``capture.interface_statistics``: packets that the capture dropped make the run incomplete.

    ``wanted`` is asked of joined datagrams, so fragments don't get lost by it;
    what can't be decoded is counted whatever it says.
    """
    settings = (settings or Settings()).validated()

    def held(df: DataFrame, name: str) -> DataFrame:
        if scratch is None:
            return df
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{scratch}/{name}")

    whole = packets.defragment(packets.decode_datagrams(rows), idle_seconds=settings.fragment_idle_seconds)
    segments = packets.decode_segments(whole)
    segments = held(segments if wanted is None else segments.where(F.col("error").isNotNull() | wanted.column()), "segments")
    large = None
    if scratch is not None:
        large = held(packets.large_flows(segments, settings.max_flow_bytes), "large_flows")
        large = None if large.isEmpty() else large
    chunks = held(packets.reassemble(segments, idle_seconds=settings.flow_idle_seconds, large=large, settings=settings, written=scratch is not None), "chunks")
    parts = held(detect_stream.parse_chunks(chunks, max_body=settings.max_body_bytes), "parts")
    found = detect_stream.detect_streams(chunks, extra_names=settings.extra_sensitive_field_names, generic_secret_scan=settings.generic_secret_scan, credit_card_scan=settings.credit_card_scan, parts=parts)
    found = detect_stream.with_provenance(found, chunks, most=settings.max_packet_ids)
    found = emit.apply_policy(found, policy=settings.material_policy, salt=settings.fingerprint_salt)
    errors = segments.where("error is not null").groupBy(F.concat(F.lit("decode_"), F.col("error")).alias("name")).agg(F.count("*").alias("value"))
    cut = segments.where("truncated").agg(F.count("*").alias("value")).select(F.lit("packets_truncated").alias("name"), "value")
    counters = errors.unionByName(cut).unionByName(detect_stream.stream_counters(chunks, parts)).unionByName(detect_stream.unmatched_responses(parts)).unionByName(detect_stream.coverage(parts))
    if statistics is not None:
        counters = counters.unionByName(statistics.agg(F.sum("dropped").alias("value")).select(F.lit("capture_dropped_packets").alias("name"), "value"))
    counters = health.merge_counters(counters).where("value > 0")
    failing = health.error_gate(segments, ["session_id"], F.col("error").isNotNull(), least=settings.error_floor, ratio=settings.error_ratio)
    reasons = failing.select(F.concat(F.lit("decode_errors:"), F.col("session_id")).alias("reason"))
    return Replay(found, counters, health.verdict(counters, reasons), chunks, reasons)


def replay(spark: SparkSession, path: str, settings: Settings | None = None, scratch: str | None = None, kept: capture.CaptureFilter = capture.ALL, wanted: PacketFilter | None = None) -> Replay:
    """``path`` names capture files on any file system that Spark reads."""
    return replay_packets(capture.read_captures(spark, path, kept), settings, scratch, capture.interface_statistics(spark, path), wanted)
