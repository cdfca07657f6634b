"""Continuous analysis of capture files that are moved into a folder.

Flows are reassembled with one state for each flow, bounded in bytes and
segments; what a bound or a timeout gives up is emitted as a gap and counted,
never dropped silently. A trigger's chunks start with the bytes that a detector
may still need, and only findings that end in new bytes are kept, so each
position is reported once however the capture is cut into files. Exchanges that
a trigger leaves open, such as a challenge without its response, are carried to
the next one for as long as their connection's state is, however many they are.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..functions import frames
from ..operators import detect_stream, emit, flow, fragments, health, packets
from ..operators.bounded import FlowState, Side, advance, finish, proceed  # noqa: F401  a flow's state is the batch's too

CHUNK = packets.CHUNK.replace("epoch long", "epoch long, fresh_start long") + ", counters map<string,long>"
#: Completeness of rows that tell which connections are over.
OVER = "over"
#: States that flows share; a checkpoint is bound to it.
SHARDS = 2_048
#: State with timers, which the joining of fragments needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reassemble_stream(segments: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of a stream of segments and datagrams whose packets have a watermark; a flow that is idle in event time is flushed and forgotten.

    Flows share states, SHARDS in all, as a state of its own costs a flow more
    than its reassembly; each is held apart there and only touched by its own
    segments and its own timeout. Datagrams go with the flows, so that what is
    before is computed once, but have no state: each is a chunk, and its packet
    its epoch.

    A connection's epoch counts from the time of the first packet that its
    flow's state has seen, so a flow that comes back has other epochs. Where
    connections of a flow are over, a row without bytes says so: its
    completeness is OVER and its epoch the first that may go on.
    """
    names = [part.split()[0] for part in CHUNK.replace("struct<start:long,stop:long,packet_ids:array<long>,time:long>", "struct").split(", ")]

    def step(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(held.get[0]) if held.exists else {}
        watermark, out, size = held.getCurrentWatermarkMs(), [], 0
        for key, chunk in advance_flows(iter(()) if held.hasTimedOut else batches, kept, watermark, settings):
            row = {"session_id": key[0], "flow_id": key[1]} | chunk
            out.append([row.get(c) for c in names])
            size += len(row["data"])
            if len(out) >= packets._ROWS or size >= packets._BYTES:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if kept:
            held.update((pickle.dumps(kept),))
            held.setTimeoutTimestamp(max(min(end for end, _ in kept.values()), watermark + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=names)

    rows = flow.canonical_flow(segments.where("error is null"))
    # missing numbers would make pandas read a column's others as floats
    tcp = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tcp_seq", "tcp_ack", "tcp_flags")]
    rows = rows.select("session_id", "flow_id", "protocol", "direction", "packet_id", "timestamp_ns", "at", "truncated", "sport", "dport", *tcp, "payload", "source_packet_ids", F.pmod(F.hash("session_id", "flow_id"), F.lit(SHARDS)).alias("shard"))
    return rows.groupBy("shard").applyInPandasWithState(step, CHUNK, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def advance_flows(batches: Iterator[pd.DataFrame], kept: dict[tuple, tuple[int, bytes]], watermark: int, settings: Settings) -> Iterator[tuple[tuple, dict]]:
    """Flow (session_id, flow_id) and chunk of what is new in flows that share a state.

    ``kept`` is brought up to date: by flow, when its rest ends, in
    milliseconds, and its own state. Of flows without new segments, those whose
    rest ended before the watermark are flushed and forgotten.
    """
    new: dict[tuple, list] = {}
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.protocol != frames.UDP:
                new.setdefault((r.session_id, r.flow_id), []).append(r)
            elif len(r.payload):
                yield (r.session_id, r.flow_id), _datagram_chunk(r)
    for key, rows in new.items():
        rows.sort(key=lambda r: (r.timestamp_ns, r.packet_id))
        state: FlowState = pickle.loads(kept[key][1]) if key in kept else FlowState(int(rows[0].timestamp_ns))
        before = state.epoch
        for chunk in proceed(state, rows, settings):
            yield key, chunk
        if state.epoch != before:
            yield key, _over(state.epoch)
        kept[key] = state.last // 1_000_000 + settings.flow_idle_seconds * 1000, pickle.dumps(state)
    for key in [k for k, (end, _) in kept.items() if end < watermark and k not in new]:
        state = pickle.loads(kept.pop(key)[1])
        for chunk in finish(state, settings):
            yield key, chunk
        yield key, _over(state.epoch + 1)


def _over(epoch: int) -> dict:
    return {"epoch": epoch, "completeness": OVER, "is_datagram": False, "data": b"", "spans": [], "retransmitted": 0, "conflicts": 0, "counters": {}}


def _datagram_chunk(r) -> dict:
    data, time = bytes(r.payload), int(r.timestamp_ns)
    return {
        "epoch": int(r.packet_id), "fresh_start": 0, "direction": int(r.direction), "sport": int(r.sport), "dport": int(r.dport), "stream_offset": 0, "cut": False, "data": data,
        "first_timestamp_ns": time, "last_timestamp_ns": time, "completeness": "truncated" if r.truncated else "complete", "is_datagram": True,
        "spans": [{"start": 0, "stop": len(data), "packet_ids": [int(i) for i in r.source_packet_ids], "time": time}], "retransmitted": 0, "conflicts": 0, "counters": {},
    }


def file_number(name: str) -> int:
    """A capture file's number, from its path: packets of the stream are told apart by it."""
    return zlib.crc32(name.encode()) & 0x7FFFFFFF


def packet_file(packet_id: Column) -> Column:
    """The number of the file of a packet of the stream."""
    return F.shiftright(packet_id, 32)


def _files(spark: SparkSession, folder: str, files_per_trigger: int) -> DataFrame:
    """Packets of files moved into ``folder``; a packet's id has its file's number above its own number there."""
    import io
    import os

    from ..sources import capture

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                above = file_number(name) << 32
                rows = capture.rows_of(io.BytesIO(content), "live", os.path.basename(name).rsplit("-", 1)[0])
                yield from capture._frames((s, None if n is None else above | n, *rest) for s, n, *rest in rows)

    return files.select("path", "content").mapInPandas(parse, capture.SCHEMA)


def chunks_of_stream(rows: DataFrame, settings: Settings) -> DataFrame:
    """Chunks (CHUNK) of a stream of packets: fragments joined and connections rebuilt with state, datagrams as they come.

    What can't be decoded, at either level, is observed as ``skipped``.
    """
    errors = F.count_if(F.col("error").isNotNull())
    timed = lambda df: df.withColumn("at", F.timestamp_millis((F.col("timestamp_ns") / 1_000_000).cast("long")))
    datagrams = timed(packets.decode_datagrams(rows)).withWatermark("at", f"{settings.flow_idle_seconds} seconds")
    whole = fragments.defragment_stream(datagrams, idle_seconds=settings.fragment_idle_seconds)
    segments = packets.decode_segments(whole)
    lost = lambda kind: F.count_if(F.col("error").like("fragment_%") & (F.col("error") == kind))
    segments = segments.observe(
        "skipped", errors.alias("undecoded"), F.count_if("truncated").alias("packets_truncated"), F.count_if(F.col("error").isNull() & (F.col("protocol") == frames.UDP)).alias("datagrams"), *(lost(k).alias(k) for k in FRAGMENT_LOSSES)
    )
    return reassemble_stream(segments, settings)


FRAGMENT_LOSSES = ("fragment_incomplete", "fragment_truncated", "fragment_malformed", "fragment_conflicting_end", "fragment_conflicting_overlap", "fragment_evicted")


def live(spark: SparkSession, folder: str, output: str, settings: Settings | None = None, *, files_per_trigger: int = 8, available_now: bool = False) -> StreamingQuery:
    """Start a query over files moved into ``folder`` (any file system of Spark); findings go to ``output``, one folder for each batch.

    A batch that is run again after a failure replaces its own folders, so
    findings and counters are written once. The session of all files is
    ``live``. Packet ids of findings tell the file (``packet_file``, by
    ``file_number``) and the packet's number there. ``Losses`` counts what
    couldn't be decoded or joined, and rows behind the watermark. The session's
    state store becomes RocksDB's, unless one with timers is set.
    """
    return analyse(_files(spark, folder, files_per_trigger), output, settings, available_now=available_now)


def analyse(rows: DataFrame, output: str, settings: Settings | None = None, *, available_now: bool = False) -> StreamingQuery:
    """As ``live``, of a stream of packets (the capture source's columns) from anywhere."""
    settings = (settings or Settings()).validated()
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # fragments give datagrams of the time of their last one, which isn't late, and lost ones, which have no flow
    spark.conf.set("spark.sql.streaming.statefulOperator.checkCorrectness.enabled", "false")
    chunks = chunks_of_stream(rows, settings)

    def write(batch: DataFrame, number: int) -> None:
        def held(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")
            return spark.read.schema(df.schema).parquet(f"{output}/{name}/batch={number}")

        def before(name: str, schema: object) -> DataFrame | None:
            return spark.read.schema(schema).parquet(f"{output}/{name}/batch={number - 1}") if number else None

        rows = held(batch, "chunks")
        new, over = rows.where(F.col("completeness") != OVER), rows.where(F.col("completeness") == OVER)
        parts = held(detect_stream.parse_chunks(new, max_body=settings.max_body_bytes), "parts")
        opened = before("open", detect_stream.PART)
        every = parts if opened is None else with_open_exchanges(parts, opened)
        kept = held(carried(every, over), "open")
        detect_stream.stream_counters(new, parts).unionByName(given_up(every, kept)).where("value > 0").write.mode("overwrite").parquet(f"{output}/counters/batch={number}")
        if opened is not None:
            parts = parts.unionByName(held(taken_up(parts, opened), "taken_up"))
        found = detect_stream.detect_streams(
            new, extra_names=settings.extra_sensitive_field_names, generic_secret_scan=settings.generic_secret_scan, credit_card_scan=settings.credit_card_scan, parts=parts
        )
        earlier = before("reported", REPORTED)
        found = held(not_reported(found, earlier), "found")
        held(reported(found, earlier, over), "reported")
        found = detect_stream.with_provenance(found, new, most=settings.max_packet_ids)
        emit.apply_policy(found, policy=settings.material_policy, salt=settings.fingerprint_salt).write.mode("overwrite").parquet(f"{output}/findings/batch={number}")

    query = chunks.writeStream.foreachBatch(write).option("checkpointLocation", f"{output}/checkpoint")
    return query.trigger(availableNow=True).start() if available_now else query.start()


_POSITION = [*detect_stream.STREAM, "detector", "material_type", "start", "stop"]
_ATTEMPTS = ["session_id", "flow_id", "epoch", "material_type"]
REPORTED = "session_id string, flow_id string, epoch long, direction int, detector string, material_type string, start long, stop long, attempt_ordinal long, observed_timestamp_ns long"


def not_reported(found: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Findings at positions that no trigger before has reported, numbered on from the last of their connection and material."""
    if earlier is None:
        return found
    fresh = found.drop("attempt_ordinal").join(earlier.select(*_POSITION), _POSITION, "left_anti")
    last = earlier.groupBy(*_ATTEMPTS).agg(F.max("attempt_ordinal").alias("last"))
    numbered = emit.attempt_ordinal(fresh, _ATTEMPTS, ["observed_timestamp_ns", "direction", "start", "stop", "detector"]).join(last, _ATTEMPTS, "left")
    return numbered.withColumn("attempt_ordinal", F.col("attempt_ordinal") + F.coalesce("last", F.lit(0))).drop("last")


def reported(found: DataFrame, earlier: DataFrame | None, over: DataFrame) -> DataFrame:
    """REPORTED: positions of connections that go on; others, and datagrams, are never read again."""
    own = found.where(~F.col("is_datagram")).select(*(c.split()[0] for c in REPORTED.split(", ")))
    return going_on(own if earlier is None else own.unionByName(earlier), over)


def going_on(rows: DataFrame, over: DataFrame) -> DataFrame:
    """``rows`` of connections that ``over`` (session_id, flow_id and, as epoch, the first that may go on) doesn't end."""
    first = over.groupBy("session_id", "flow_id").agg(F.max("epoch").alias("__first"))
    return rows.join(first, ["session_id", "flow_id"], "left").where(F.col("__first").isNull() | (F.col("epoch") >= F.col("__first"))).select(*rows.columns)


def carried(parts: DataFrame, over: DataFrame) -> DataFrame:
    """All records of exchanges that later bytes may go on: those of connections that aren't ``over``. A datagram's end with it."""
    return going_on(parts.where((F.col("part") == "record") & F.col("detector").isin(*detect_stream.EXCHANGED) & ~F.col("is_datagram")), over)


def taken_up(parts: DataFrame, before: DataFrame) -> DataFrame:
    """Of the records carried to ``parts``, those of connections that have new ones, to which alone they can be related; without those that are there again."""
    connection = ["session_id", "flow_id", "epoch"]
    return _not_again(parts, before).join(parts.where("part = 'record'").select(*connection).distinct(), connection, "left_semi").select(*before.columns)


def open_exchanges(parts: DataFrame, seconds: int, *, per_flow: int = 64, total: int = 65_536) -> DataFrame:
    """A bounded look at exchanges that may be open: records of the last ``seconds`` before the latest record.

    Of a connection the latest ``per_flow`` stay, of all the latest ``total``:
    what came first goes first. No query works on it: the stream carries all
    (``carried``).
    """
    rows = parts.where((F.col("part") == "record") & F.col("detector").isin(*detect_stream.EXCHANGED))
    latest = parts.agg(F.max("observed_timestamp_ns")).first()[0] or 0
    recent = rows.where(F.col("observed_timestamp_ns") >= latest - seconds * 1_000_000_000)
    order = [F.desc("observed_timestamp_ns"), F.desc("start"), "direction"]
    last = F.row_number().over(W.partitionBy("session_id", "flow_id", "epoch").orderBy(*order))
    return recent.withColumn("__nth", last).where(F.col("__nth") <= per_flow).drop("__nth").orderBy(*order, "session_id", "flow_id", "epoch").limit(total)


def given_up(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """One counter: challenges and responses that no trigger will see again, as they aren't ``kept``, and that had no counterpart so far."""
    rows = parts.where("part = 'record' and detector in ('ntlm_type2_challenge', 'ntlm_type3_response')").select(*detect_stream.STREAM, "detector", "start", "stop")
    key = [*detect_stream.STREAM, "detector", "start", "stop"]
    gone = rows.join(kept.select(*key), key, "left_anti")
    sides = lambda detector: rows.where(F.col("detector") == detector).select("session_id", "flow_id", "epoch").distinct()
    alone = [gone.where(F.col("detector") == one).join(sides(other), ["session_id", "flow_id", "epoch"], "left_anti") for one, other in (("ntlm_type2_challenge", "ntlm_type3_response"), ("ntlm_type3_response", "ntlm_type2_challenge"))]
    return alone[0].unionByName(alone[1]).agg(F.count("*").alias("value")).select(F.lit("coverage_ntlm_unmatched_at_eviction").alias("name"), "value")


def _not_again(parts: DataFrame, before: DataFrame) -> DataFrame:
    key = [*detect_stream.STREAM, "detector", "start", "stop"]
    return before.join(parts.where("part = 'record'").select(*key), key, "left_anti")


def with_open_exchanges(parts: DataFrame, before: DataFrame) -> DataFrame:
    """``parts`` and the records carried to them; a record in bytes that are read again is taken once."""
    return parts.unionByName(_not_again(parts, before))


class Losses(StreamingQueryListener):
    """What a query's progress tells of loss and time: add it to ``spark.streams`` before the query starts.

    Rows behind the watermark are dropped by Spark and only counted in the
    progress. A batch that is run again counts once, by its last run.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        """Nothing to count yet."""

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        skipped = p.observedMetrics.get("skipped")
        seen = skipped.asDict() if skipped is not None and hasattr(skipped, "asDict") else dict(skipped or {})
        self.batches[str(p.id), p.batchId] = {
            "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "undecoded_frames": seen.get("undecoded") or 0,
            "milliseconds": p.batchDuration,
            **{name: seen.get(name) or 0 for name in ("packets_truncated", *FRAGMENT_LOSSES)},
        }

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        """An idle query loses nothing."""

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        """What was counted stays."""

    def _of(self, query: str) -> list[dict[str, int]]:
        return [held for (name, _), held in self.batches.items() if name == query]

    def counters(self, spark: SparkSession, query: str) -> DataFrame:
        names = ("late_rows", "undecoded_frames", "packets_truncated", *FRAGMENT_LOSSES)
        return spark.createDataFrame([(n, sum(b[n] for b in self._of(query))) for n in names], "name string, value long")

    def timing(self, query: str) -> dict[str, int]:
        """Batches, and milliseconds in all and of the longest."""
        took = [b["milliseconds"] for b in self._of(query)]
        return {"batches": len(took), "total": sum(took), "longest": max(took, default=0)}


def live_verdict(spark: SparkSession, output: str, losses: Losses, query: str) -> DataFrame:
    """The verdict on all batches that a query has written, with its ``losses`` since they were first listened to."""
    written = spark.read.schema("name string, value long").parquet(f"{output}/counters")
    return health.verdict(health.merge_counters(written.select("name", "value").unionByName(losses.counters(spark, query))))


def heartbeats(events: DataFrame, time: str, *, lateness: str = "1 minute", width: str = "10 seconds") -> DataFrame:
    """Counts of events in fixed windows of event time, each emitted once when the watermark has passed it."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width)).agg(F.count("*").alias("events"))
