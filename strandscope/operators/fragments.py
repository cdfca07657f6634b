"""Datagrams from IP fragments: one state for each use of a fragment id, which is free again when its datagram is complete.

The same state serves a batch, which reads the fragments of an id in the order
of packets, and a stream, which keeps it between triggers.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames

# Bounds of a datagram.
MAX_DATAGRAM, MAX_RANGES = 2 << 20, 4_096

KEYS = ("session_id", "interface", "vlans", "ip_version", "src", "dst", "protocol", "fragment_id")


class Fragment(NamedTuple):
    packet_id: int
    time: int
    offset: int
    payload: bytes
    more: bool
    truncated: bool
    source_packet_ids: tuple[int, ...]


class Outcome(NamedTuple):
    """A datagram's payload, or why there is none, with the packets that gave it bytes and the latest packet and time."""

    payload: bytes | None
    error: str | None
    source_packet_ids: tuple[int, ...]
    packet_id: int
    time: int


class Assembly:
    """What has come of one datagram: disjoint ranges in order, of which those that touch are joined; the bytes seen first stay."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int, bytearray]] = []
        self.end: int | None = None
        self.truncated = False
        self.ids: dict[int, None] = {}
        self.packet_id = self.time = 0

    def _outcome(self, payload: bytes | None, error: str | None) -> Outcome:
        return Outcome(payload, error, tuple(self.ids), self.packet_id, self.time)

    def lost(self) -> Outcome:
        """The outcome if nothing more comes."""
        return self._outcome(None, "fragment_truncated" if self.truncated else "fragment_incomplete")

    def add(self, f: Fragment) -> Outcome | None:
        """Take a fragment; None while the datagram isn't complete. After an outcome the id is free."""
        stop = f.offset + len(f.payload)
        self.packet_id, self.time = max(self.packet_id, f.packet_id), max(self.time, f.time)
        self.truncated = self.truncated or f.truncated
        if f.offset < 0 or stop > MAX_DATAGRAM or (f.more and (not f.payload or len(f.payload) % 8)):
            return self._outcome(None, "fragment_malformed")
        if not f.more:
            if self.end not in (None, stop):
                return self._outcome(None, "fragment_conflicting_end")
            self.end = stop
        lo = bisect_left(self.ranges, f.offset, key=lambda r: r[0] + len(r[1]))
        hi = lo
        joined, start = bytearray(f.payload), f.offset
        new = len(f.payload) > 0
        while hi < len(self.ranges) and self.ranges[hi][0] <= stop:
            at, held = self.ranges[hi]
            a, b = max(at, f.offset), min(at + len(held), stop)
            if a < b and held[a - at : b - at] != f.payload[a - f.offset : b - f.offset]:
                return self._outcome(None, "fragment_conflicting_overlap")
            new = new and not (at <= f.offset and stop <= at + len(held))
            if at < start:
                joined[:0], start = held[: start - at], at
            over = at + len(held) - (start + len(joined))
            if over > 0:
                joined += held[-over:]
            hi += 1
        if f.payload:
            self.ranges[lo:hi] = [(start, joined)]
        if new or not self.ids:
            self.ids.update(dict.fromkeys(f.source_packet_ids))
        if self.end is not None and self.ranges and self.ranges[-1][0] + len(self.ranges[-1][1]) > self.end:
            return self._outcome(None, "fragment_conflicting_end")
        if len(self.ranges) > MAX_RANGES:
            return self._outcome(None, "fragment_evicted")
        if self.end is None or len(self.ranges) != 1 or self.ranges[0][0] or len(self.ranges[0][1]) != self.end:
            return None
        return self._outcome(None, "fragment_truncated") if self.truncated else self._outcome(bytes(self.ranges[0][1]), None)


def step(held: Assembly | None, f: Fragment, idle_ns: int) -> tuple[Assembly | None, list[Outcome]]:
    """State and outcomes after a fragment: an id that rested for ``idle_ns`` is used anew."""
    out = []
    if held is not None and f.time - held.time >= idle_ns:
        out.append(held.lost())
        held = None
    held = held or Assembly()
    done = held.add(f)
    return (None, [*out, done]) if done else (held, out)


def _fragment(r: Any) -> Fragment:
    return Fragment(int(r.packet_id), int(r.timestamp_ns), int(r.fragment_offset), bytes(r.network_payload), bool(r.more_fragments), bool(r.truncated), tuple(int(i) for i in r.source_packet_ids))


def _row(key: Any, vlan_ids: Any, outcome: Outcome) -> dict:
    """A row of a datagram; of an IPv6 one, the extension headers behind the fragment header are read now that all are there."""
    row = dict(zip(KEYS, key, strict=True)) | {"vlan_ids": vlan_ids, "packet_id": outcome.packet_id, "timestamp_ns": outcome.time, "network_payload": outcome.payload, "truncated": False, "fragment_id": None, "fragment_offset": 0, "more_fragments": False, "source_packet_ids": sorted(outcome.source_packet_ids), "error": outcome.error}
    if outcome.payload is not None and row["ip_version"] == 6:
        try:
            kind, at, _ = frames.skip_extensions(int(row["protocol"]), outcome.payload, 0)
            row |= {"protocol": kind, "network_payload": outcome.payload[at:]}
        except frames.FrameError as problem:
            row |= {"network_payload": None, "error": str(problem)}
    return row


def _parted(datagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole datagrams and error rows, and fragments with their key's columns. A fragment that is all of its datagram is whole."""
    is_part = F.col("fragment_id").isNotNull() & ((F.col("fragment_offset") > 0) | F.col("more_fragments"))
    vlans = F.concat_ws(",", F.transform("vlan_ids", lambda v: v.cast("string")))
    return datagrams.where(~is_part | F.col("fragment_id").isNull()), datagrams.where(is_part).withColumn("vlans", vlans)


def _frame(rows: list[dict]):
    from . import packets

    return packets._frame(rows, packets.DATAGRAM)


def defragment(datagrams: DataFrame, *, idle_seconds: int = 30) -> DataFrame:
    """``datagrams`` with fragments replaced by the datagrams that they make, or by an error row.

    Whole datagrams don't move. Fragments of a session, interface, VLANs,
    version, addresses, protocol and id are read in the order of packets; a
    task holds one datagram at a time, however often an id comes back. Packet
    id and time are the latest's.
    """
    from . import packets

    whole, parts = _parted(datagrams)
    idle_ns = idle_seconds * 1_000_000_000

    def join(batches: Iterator) -> Iterator:
        key = held = vlans = None
        for batch in batches:
            rows = []
            keys = zip(*(batch[k].tolist() for k in KEYS), strict=True)
            values = zip(*(batch[c].tolist() for c in ("vlan_ids", "packet_id", "timestamp_ns", "fragment_offset", "network_payload", "more_fragments", "truncated", "source_packet_ids")), strict=True)
            for own, (tags, number, time, offset, payload, more, truncated, numbers) in zip(keys, values, strict=True):
                if own != key:
                    if held is not None:
                        rows.append(_row(key, vlans, held.lost()))
                    key, held, vlans = own, None, list(tags)
                held, done = step(held, Fragment(number, time, offset, bytes(payload), more, truncated, tuple(numbers)), idle_ns)
                rows += [_row(key, vlans, o) for o in done]
                if len(rows) >= packets._ROWS:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)
        if held is not None:
            yield _frame([_row(key, vlans, held.lost())])

    joined = parts.repartition(*KEYS).sortWithinPartitions(*KEYS, "packet_id").mapInPandas(join, packets.DATAGRAM)
    return whole.unionByName(joined)


def stream_processor(idle_seconds: int):
    """A stateful processor of one id's fragments: an event-time timer gives up what rests."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    idle_ns = idle_seconds * 1_000_000_000

    class Fragments(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("assembly", "held binary, vlans array<int>")

        def _load(self) -> tuple[Assembly | None, list[int]]:
            if not self.state.exists():
                return None, []
            held, vlans = self.state.get()
            return pickle.loads(held), list(vlans)

        def _store(self, held: Assembly | None, vlans: list[int]) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held is None:
                self.state.clear()
            else:
                self.state.update((pickle.dumps(held), vlans))
                self.handle.registerTimer(held.time // 1_000_000 + idle_seconds * 1000)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import pandas as pd

            held, vlans = self._load()
            out = []
            for r in pd.concat(rows).sort_values(["timestamp_ns", "packet_id"]).itertuples(index=False):
                vlans = [int(v) for v in r.vlan_ids]
                held, done = step(held, _fragment(r), idle_ns)
                out += [_row(key, vlans, o) for o in done]
            self._store(held, vlans)
            yield _timed(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            held, vlans = self._load()
            self.state.clear()
            yield _timed([_row(key, vlans, held.lost())] if held else [])

        def close(self) -> None:
            """Nothing is held but state."""

    return Fragments()


def _timed(rows: list[dict]):
    import pandas as pd

    out = _frame(rows)
    out["at"] = pd.to_datetime(out["timestamp_ns"].astype("int64"), unit="ns") if len(out) else pd.Series([], dtype="datetime64[ns]")
    return out


def defragment_stream(datagrams: DataFrame, *, idle_seconds: int = 30) -> DataFrame:
    """As ``defragment``, of a stream with event time ``at``: a state for each id, given up when event time passes its rest.

    Needs a state store with timers, such as RocksDB's.
    """
    from . import packets

    whole, parts = _parted(datagrams)
    joined = parts.groupBy(*KEYS).transformWithStateInPandas(stream_processor(idle_seconds), packets.DATAGRAM + ", at timestamp", "append", "eventTime", eventTimeColumnName="at")
    return whole.unionByName(joined)
