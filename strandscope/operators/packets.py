"""Packets to datagrams to streams: decoding, IP reassembly, TCP reassembly."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import frames
from . import flow, fragments

_ADDRESS = "session_id string, packet_id long, timestamp_ns long, interface string, ip_version int, src string, dst string, protocol int, vlan_ids array<int>"
DATAGRAM = _ADDRESS + ", network_payload binary, truncated boolean, fragment_id long, fragment_offset int, more_fragments boolean, source_packet_ids array<long>, error string"
SEGMENT = _ADDRESS + ", truncated boolean, sport int, dport int, tcp_seq long, tcp_ack long, tcp_flags int, payload binary, source_packet_ids array<long>, error string"
CHUNK = "session_id string, flow_id string, epoch long, direction int, sport int, dport int, stream_offset long, cut boolean, data binary, first_timestamp_ns long, last_timestamp_ns long, completeness string, is_datagram boolean, spans array<struct<start:long,stop:long,packet_ids:array<long>,time:long>>, retransmitted long, conflicts long"
FIN, SYN, RST, ACK = 1, 2, 4, 16


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


#: Rows and bytes after which a task hands on what it has made, so that its memory doesn't grow with what a batch becomes.
_ROWS, _BYTES = 2_048, 16 << 20

_INTS = ("packet_id", "timestamp_ns", "ip_version", "protocol", "fragment_id", "fragment_offset", "sport", "dport", "tcp_seq", "tcp_ack", "tcp_flags")


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = _names(schema)
    # a value that is missing is None, not NaN, which text columns don't take
    out = pd.DataFrame([[row.get(c) for c in names] for row in rows], columns=names)
    return out.astype({c: "Int64" for c in _INTS if c in out.columns})


def _pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (batch.iloc[a : a + _ROWS] for a in range(0, len(batch), _ROWS))


def decode_datagrams(packets: DataFrame) -> DataFrame:
    """One row for each IP datagram or fragment, and one with an error for each frame that should be IP but isn't readable. Other frames are left out."""

    names = _names(DATAGRAM)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            rows = []
            columns = (batch[c] for c in ("session_id", "packet_id", "timestamp_ns", "interface", "datalink", "wire_length", "raw", "error"))
            for session, number, time, interface, link, wire, raw, error in zip(*columns, strict=True):
                if error is not None:
                    rows.append((session, None, None, interface, *[None] * 11, error))
                    continue
                try:
                    d = frames.datagram(raw, int(link), int(wire))
                except frames.FrameError as problem:
                    rows.append((session, number, time, interface, *[None] * 11, str(problem)))
                    continue
                if d:
                    rows.append((session, number, time, interface, d.version, d.src, d.dst, d.protocol, d.vlans, d.payload, d.truncated, d.fragment_id, d.fragment_offset, d.more_fragments, (number,), None))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in _INTS if c in names})

    return packets.select("session_id", "packet_id", "timestamp_ns", "interface", "datalink", "wire_length", "raw", "error").mapInPandas(decode, DATAGRAM)


def join_fragments(parts: list[tuple[int, int, bytes, bool, bool]]) -> tuple[bytes | None, str | None]:
    """Payload of a datagram from fragments (packet_id, offset, payload, more, truncated) in order of packets, or why there is none."""
    held = fragments.Assembly()
    for number, offset, payload, more, truncated in parts:
        done = held.add(fragments.Fragment(number, 0, offset, payload, more, truncated, (number,)))
        if done:
            return done.payload, done.error
    return None, held.lost().error


defragment = fragments.defragment


_TRANSPORT = "known boolean, sport int, dport int, tcp_seq long, tcp_ack long, tcp_flags int, payload binary, error string"


def _transport(protocol: pd.Series, payload: pd.Series, truncated: pd.Series, error: pd.Series) -> pd.DataFrame:
    rows = []
    for kind, data, cut, before in zip(protocol, payload, truncated, error, strict=True):
        if before is not None:
            rows.append((True, None, None, None, None, None, None, before))
            continue
        try:
            s = frames.segment(int(kind), bytes(data), bool(cut))
            rows.append((True, *s, None) if s else (False, *[None] * 7))
        except frames.FrameError as problem:
            rows.append((True, None, None, None, None, None, None, str(problem)))
    out = pd.DataFrame(rows, columns=_names(_TRANSPORT))
    return out.astype({c: "Int64" for c in _INTS if c in out.columns} | {"known": bool})


def decode_segments(datagrams: DataFrame) -> DataFrame:
    """TCP and UDP of whole datagrams; an error row where a header can't be read. Other protocols are left out.

    A column ``at`` of event time is kept, with its watermark.
    """
    # evaluated once, and not again where its result is filtered
    parsed = datagrams.withColumn("__t", F.pandas_udf(_transport, _TRANSPORT).asNondeterministic()("protocol", "network_payload", "truncated", "error"))
    own = _names(SEGMENT)
    taken = [F.col(f"__t.{c}").alias(c) if c in _names(_TRANSPORT) else F.col(c) for c in own]
    return parsed.where("__t.known").select(*taken, *(c for c in datagrams.columns if c == "at"))


class Direction:
    """One direction of a TCP connection: bytes by stream offset, those of the earliest packet winning."""

    def __init__(self) -> None:
        self.base: int | None = None  # unwrapped sequence number of stream offset 0
        self.reference = 0
        self.midstream = False
        self.ranges: list[tuple[int, int, bytes, list[int], int]] = []  # start, stop, data, packets, time; disjoint and ascending
        self.reached = 0  # where the bytes from offset 0 on are contiguous to
        self.repeated = self.conflicts = 0
        self.acked = -1  # how far the peer has acknowledged, as a stream offset
        self.fin = False

    def unwrap(self, seq: int) -> int:
        """The number equal to ``seq`` modulo 2**32 that is nearest to the last one seen."""
        near = (self.reference & ~0xFFFFFFFF) | seq
        return min((near - (1 << 32), near, near + (1 << 32)), key=lambda x: abs(x - self.reference))

    def open(self, seq: int) -> None:
        self.base = self.reference = (1 << 32) + seq + 1

    def _advance(self) -> None:
        n = bisect_left(self.ranges, self.reached, key=lambda r: r[0])
        while n < len(self.ranges) and self.ranges[n][0] == self.reached:
            self.reached = self.ranges[n][1]
            n += 1

    def add(self, seq: int, data: bytes, packets: list[int], time: int) -> None:
        if self.base is None:
            self.base = self.reference = (1 << 32) + seq
            self.midstream = True
        place = self.unwrap(seq)
        self.reference = max(self.reference, place)
        start = place - self.base
        if start < 0:  # before the start that is known: a late beginning can't be placed
            data, start = data[-start:], 0
        if not data:
            return
        if not self.ranges or start >= self.ranges[-1][1]:  # in order, as most are
            self.ranges.append((start, start + len(data), data, packets, time))
            if start == self.reached:
                self.reached = start + len(data)
            return
        at, stop, fresh = start, start + len(data), []
        first = bisect_right(self.ranges, start, key=lambda r: r[1])
        last = bisect_left(self.ranges, stop, lo=first, key=lambda r: r[0])
        met = self.ranges[first:last]
        for a, b, held, *_ in met:
            if a > at:
                fresh.append((at, a))
            lo, hi = max(a, at), min(b, stop)
            self.repeated += hi - lo
            self.conflicts += held[lo - a : hi - a] != data[lo - start : hi - start]
            at = max(at, hi)
        if at < stop:
            fresh.append((at, stop))
        new = [(a, b, data[a - start : b - start], packets, time) for a, b in fresh if a < b]
        self.ranges[first:last] = sorted([*met, *new], key=lambda r: r[0])
        self._advance()

    def runs(self) -> list[list[tuple[int, int, bytes, list[int], int]]]:
        """Maximal runs of contiguous ranges."""
        out: list[list] = []
        for r in self.ranges:
            if out and out[-1][-1][1] == r[0]:
                out[-1].append(r)
            else:
                out.append([r])
        return out


_FIELDS = ("direction", "timestamp_ns", "sport", "dport", "tcp_seq", "tcp_ack", "tcp_flags", "payload", "source_packet_ids")


def reassemble_flow(group: pd.DataFrame, idle_seconds: int | None = None) -> list[dict]:
    """Chunks of all connections of one flow from its segments; without acknowledgements' numbers, nothing is acknowledged."""
    known = group if "tcp_ack" in group else group.assign(tcp_ack=0, tcp_flags=group["tcp_flags"] & ~ACK)
    return connections(zip(*(known.sort_values("packet_id")[c].tolist() for c in _FIELDS), strict=True), idle_seconds)


def connections(segments: Iterable[tuple], idle_seconds: int | None = None) -> list[dict]:
    """Chunks of all connections of one flow from its segments (values of _FIELDS), which are in order of packets.

    A SYN with another sequence number, or after a close, opens a new epoch, and
    so does a segment after ``idle_seconds`` of rest.
    One byte below the next one expected is a keep-alive if the peer has
    acknowledged it. Holes stay: what
    follows one is a chunk of its own, marked gapped, at its true offset.
    """
    epochs: list[dict] = []
    sides: list[Direction] = [Direction(), Direction()]
    syn: list[int | None] = [None, None]
    closed, latest = False, None

    def begin() -> None:
        nonlocal sides, syn, closed
        sides, syn, closed = [Direction(), Direction()], [None, None], False
        epochs.append({"sides": sides, "ports": [(None, None), (None, None)]})

    begin()
    for d, time, sport, dport, seq, ack, flags, payload, numbers in segments:
        if idle_seconds and latest is not None and time - latest >= idle_seconds * 1_000_000_000:
            begin()
        latest = max(latest or time, time)
        if flags & SYN and not flags & ACK and (closed or (syn[d] is not None and syn[d] != seq) or (syn[d] is None and sides[d].base is not None)):
            begin()
        epochs[-1]["ports"][d] = (sport, dport)
        data = bytes(payload)
        if flags & SYN:
            if syn[d] is None:
                syn[d] = seq
                sides[d].open(seq)
            seq = (seq + 1) & 0xFFFFFFFF
        side, peer = sides[d], sides[1 - d]
        if flags & ACK and peer.base is not None:
            peer.acked = max(peer.acked, peer.unwrap(ack) - peer.base)
        probe = len(data) == 1 and flags & ACK and not flags & (SYN | FIN | RST) and side.base is not None
        keep_alive = probe and side.unwrap(seq) - side.base == side.reached - 1 >= 0 and side.acked >= side.reached
        if data and not keep_alive:
            side.add(seq, data, list(numbers), time)
        closed = closed or bool(flags & RST) or (bool(flags & FIN) and (side.fin or peer.fin))
        side.fin = side.fin or bool(flags & FIN)
    rows = []
    kept = [e for e in epochs if any(s.ranges for s in e["sides"])]
    for number, epoch in enumerate(kept):
        for d, side in enumerate(epoch["sides"]):
            for n, run in enumerate(side.runs()):
                gapped = n > 0 or run[0][0] > 0
                rows.append(
                    {"epoch": number, "direction": d, "sport": epoch["ports"][d][0], "dport": epoch["ports"][d][1], "stream_offset": run[0][0], "cut": False, "data": b"".join(x[2] for x in run)}
                    | {"first_timestamp_ns": min(x[4] for x in run), "last_timestamp_ns": max(x[4] for x in run), "completeness": "gapped" if gapped else "midstream" if side.midstream else "complete"}
                    | {"is_datagram": False, "spans": [{"start": x[0], "stop": x[1], "packet_ids": x[3], "time": x[4]} for x in run], "retransmitted": side.repeated if n == 0 else 0, "conflicts": side.conflicts if n == 0 else 0}
                )
    return rows


_NEEDED = ["session_id", "flow_id", "direction", "packet_id", "timestamp_ns", "sport", "dport", "tcp_seq", "tcp_ack", "tcp_flags", "payload", "source_packet_ids"]


def by_flow(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, str], pd.DataFrame, bool]]:
    """Flow, rows and whether they are its first, of rows that come flow by flow; a flow may come in several parts."""
    before = None
    for batch in batches:
        edges = (batch["flow_id"] != batch["flow_id"].shift()) | (batch["session_id"] != batch["session_id"].shift())
        starts = edges.to_numpy().nonzero()[0].tolist()
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            key = batch["session_id"].iloc[a], batch["flow_id"].iloc[a]
            yield key, batch.iloc[a:b], key != before
            before = key


def large_flows(segments: DataFrame, most: int) -> DataFrame:
    """session_id and flow_id of the TCP flows with more than ``most`` payload bytes, and their bytes."""
    rows = flow.canonical_flow(segments.where(f"error is null and protocol = {frames.TCP}"))
    return rows.groupBy("session_id", "flow_id").agg(F.sum(F.length("payload").cast("long")).alias("bytes")).where(F.col("bytes") > most)


def _in_order(tcp: DataFrame) -> DataFrame:
    return tcp.select(*_NEEDED).repartition("session_id", "flow_id").sortWithinPartitions("session_id", "flow_id", "packet_id")


def reassemble_large(tcp: DataFrame, settings: Settings, piece: int = 4 << 20) -> DataFrame:
    """Chunks of flows of any size, each in bounded memory.

    A flow's segments are read in order, ``piece`` bytes at a time, with the
    state that a stream keeps; each piece is a chunk that begins with what
    detectors may need again. Bytes behind a gap wait within
    ``max_pending_bytes`` and ``max_pending_segments``; beyond those the gap is
    given up, and counted in the chunk's ``counters``.
    """
    from . import bounded

    names = [*_names(CHUNK.split(", spans")[0]), "spans", "retransmitted", "conflicts", "counters"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None

        def rows(chunks: list[dict]) -> pd.DataFrame:
            # what was sent again is a counter here, and a column in a whole flow's chunk
            out = [{"session_id": key[0], "flow_id": key[1]} | c | {"retransmitted": c["counters"].pop("retransmitted_bytes", 0)} for c in chunks]
            return pd.DataFrame([[r.get(c) for c in names] for r in out], columns=names)

        for own, part, first in by_flow(batches):
            if first:
                if state is not None:
                    yield rows(bounded.finish(state, settings))
                key, state = own, bounded.FlowState()
            for some in bounded.pieces(part, piece):
                yield rows(bounded.advance(state, some, settings))
        if state is not None:
            yield rows(bounded.finish(state, settings))

    return _in_order(tcp).mapInPandas(build, CHUNK + ", counters map<string,long>")


def reassemble(segments: DataFrame, *, idle_seconds: int | None = None, large: DataFrame | None = None, settings: Settings | None = None, written: bool = False) -> DataFrame:
    """Chunks (CHUNK) of contiguous bytes of every TCP connection and direction, and of every UDP datagram.

    A TCP flow is read by one task: its order of packets matters. Flows are
    spread by hash, many to a task, and datagrams singly with them, so that
    packets are decoded once; where segments are a ``written`` table, which is
    cheap to read twice, datagrams, which need no order, don't move. A flow is held whole, but for those that ``large`` (of
    ``large_flows``) names, which come in several chunks of bounded size.
    ``counters`` are what the bounds gave up.
    """
    rows = flow.canonical_flow(segments.where("error is null"))
    is_tcp = F.col("protocol") == frames.TCP
    tcp = rows.where(is_tcp)

    names = [*_names(CHUNK.split(", spans")[0]), "spans", "retransmitted", "conflicts"]

    def datagram(session: str, name: str, number: int, truncated: bool, d: int, time: int, sport: int, dport: int, seq: None, ack: None, flags: None, payload: bytes, numbers: list[int]) -> list:
        span = {"start": 0, "stop": len(payload), "packet_ids": list(numbers), "time": time}
        return [session, name, number, d, sport, dport, 0, False, payload, time, time, "truncated" if truncated else "complete", True, [span], 0, 0]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Flows come one after the other, many in a batch; the last one of a batch may go on in the next."""
        key, held, out, size = None, [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal out, size
            done, out, size = pd.DataFrame(out, columns=names), [], 0
            return done

        def close() -> None:
            nonlocal held, size
            for r in connections(held, idle_seconds):
                out.append([*key, *(r[c] for c in names[2:])])
                size += len(r["data"])
            held = []

        for batch in batches:
            for protocol, truncated, number, session, name, *segment in zip(*(batch[c].tolist() for c in ("protocol", "truncated", "packet_id", "session_id", "flow_id", *_FIELDS)), strict=True):
                if protocol == frames.UDP:
                    out.append(datagram(session, name, number, truncated, *segment))
                    size += len(segment[_FIELDS.index("payload")])
                    if len(out) >= _ROWS or size >= _BYTES:
                        yield flush()
                    continue
                if (session, name) != key:
                    if key:
                        close()
                    key = session, name
                    if len(out) >= _ROWS or size >= _BYTES:
                        yield flush()
                held.append(segment)
        if key:
            close()
        yield flush()

    keys = ["session_id", "flow_id"]
    moved = tcp if written else rows.where(is_tcp | ((F.col("protocol") == frames.UDP) & (F.length("payload") > 0)))
    small = moved if large is None else moved.join(large.select(*keys), keys, "left_anti")
    no_counters = F.lit(None).cast("map<string,long>").alias("counters")
    # missing numbers would make pandas read a column's others as floats
    needed = [F.coalesce(c, F.lit(0)).alias(c) if c.startswith("tcp_") else c for c in ("protocol", "truncated", *_NEEDED)]
    alone = F.when(F.col("protocol") == frames.UDP, F.col("packet_id"))
    streams = small.select(*needed).repartition(*keys, alone).sortWithinPartitions(*keys, "packet_id").mapInPandas(build, CHUNK).select("*", no_counters)
    if large is not None:
        streams = streams.unionByName(reassemble_large(tcp.join(large.select(*keys), keys, "left_semi"), settings or Settings()))
    return streams.unionByName(datagram_chunks(rows).select("*", no_counters)) if written else streams


def datagram_chunks(rows: DataFrame) -> DataFrame:
    """A chunk (CHUNK) of each UDP datagram among ``rows`` (of ``canonical_flow``) that has a payload."""
    size = F.length("payload").cast("long")
    span = F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop"), F.col("source_packet_ids").alias("packet_ids"), F.col("timestamp_ns").alias("time"))
    return rows.where((F.col("protocol") == frames.UDP) & (size > 0)).select(
        "session_id", "flow_id", F.col("packet_id").alias("epoch"), "direction", "sport", "dport", F.lit(0).cast("long").alias("stream_offset"), F.lit(False).alias("cut"), F.col("payload").alias("data"),
        F.col("timestamp_ns").alias("first_timestamp_ns"), F.col("timestamp_ns").alias("last_timestamp_ns"), F.when(F.col("truncated"), "truncated").otherwise("complete").alias("completeness"),
        F.lit(True).alias("is_datagram"), F.array(span).alias("spans"), F.lit(0).cast("long").alias("retransmitted"), F.lit(0).cast("long").alias("conflicts"),
    )
