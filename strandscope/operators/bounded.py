"""Reassembly of a flow in bounded memory: what came is handed out as it becomes contiguous, and forgotten.

The state of a flow has, for each direction, what waits behind a gap, bounded
in bytes and segments, and a tail of what was handed out, which detectors may
need again. The stream keeps it between triggers; a batch, between the pieces
in which it reads a flow that no task could hold.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd

from ..config import Settings
from ..functions import http1, wire
from . import packets

#: Fixed counters' names.
FORCED_GAP = "tcp_forced_gap_bytes"


class Side:
    """One direction's state: what is contiguous so far, ranges that wait for a gap to close, and the tail that may be needed again."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.reference = 0
        self.next = 0  # contiguous up to here
        self.waiting: list[tuple[int, bytes, list[int], int]] = []
        self.held = 0  # bytes that wait
        self.tail, self.tail_start, self.tail_cut = b"", 0, False
        self.tail_spans: list[dict] = []
        self.due = 0  # where a message ends whose beginning is too far back to be read again
        self.midstream = self.gapped = self.fin = False
        self.acked = -1  # how far the peer has acknowledged
        self.ports: tuple[int | None, int | None] = (None, None)

    def place(self, seq: int) -> int:
        near = (self.reference & ~0xFFFFFFFF) | seq
        return min((near - (1 << 32), near, near + (1 << 32)), key=lambda x: abs(x - self.reference))


class FlowState:
    def __init__(self, epoch: int = 0) -> None:
        self.epoch, self.last = epoch, 0
        self.sides = [Side(), Side()]
        self.syn: list[int | None] = [None, None]
        self.closed = False

    def begin(self) -> None:
        self.epoch += 1
        self.sides, self.syn, self.closed = [Side(), Side()], [None, None], False


def _take(side: Side, fresh: list[tuple[int, bytes, list[int], int]], counters: Counter) -> None:
    """Move waiting ranges that continue what is contiguous to ``fresh``; of several, the one that came first."""
    if len(side.waiting) == 1 and side.waiting[0][0] == side.next:  # in order, as most are
        (_, data, ids, time), side.waiting, side.held = side.waiting[0], [], 0
        fresh.append((side.next, data, ids, time))
        side.next += len(data)
        return
    order = sorted(range(len(side.waiting)), key=lambda n: side.waiting[n][0])
    ready: list[int] = []
    moved: set[int] = set()
    at = 0
    while True:
        while at < len(order) and side.waiting[order[at]][0] <= side.next:
            heapq.heappush(ready, order[at])
            at += 1
        if not ready:
            break
        n = heapq.heappop(ready)
        moved.add(n)
        start, data, ids, time = side.waiting[n]
        new = data[side.next - start :]
        counters["retransmitted_bytes"] += len(data) - len(new)
        side.held -= len(data)
        if new:
            fresh.append((side.next, new, ids, time))
            side.next += len(new)
    if moved:
        side.waiting = [w for n, w in enumerate(side.waiting) if n not in moved]


def _skip(side: Side, counters: Counter) -> None:
    """Give up the hole before the first waiting range."""
    side.waiting.sort(key=lambda w: w[0])
    counters[FORCED_GAP] += side.waiting[0][0] - side.next
    side.next, side.gapped = side.waiting[0][0], True
    side.tail, side.tail_spans, side.tail_start, side.tail_cut, side.due = b"", [], side.next, False, 0


def resume(data: bytes, ports: Iterable[int | None], overlap: int, counters: Counter) -> tuple[int, bool, int]:
    """From where ``data`` is read again with what follows it, whether that place is in the middle of something, and where a message ends that goes on beyond.

    A message that is complete won't be needed again. Where no parser knows
    where messages end, the last ``overlap`` bytes are kept, from a line's
    start if there is one.
    """
    due = 0
    try:
        messages = http1.frame(data, Counter())
        whole = max([*(m.end for m in messages if m.complete), wire.last_unit(data, {p for p in ports if p is not None})], default=0)
        due = messages[-1].due if messages else 0
    except Exception:  # noqa: BLE001  hostile bytes are no reason to stop a flow
        counters["parser_error:resume"] += 1
        whole = 0
    least = len(data) - overlap
    if whole >= least or least <= 0:
        return max(whole, 0), False, 0
    line = data.find(b"\n", least)
    return (line + 1, False, due) if 0 <= line < len(data) - 1 else (least, True, due)


def _emit(state: FlowState, d: int, fresh: list[tuple[int, bytes, list[int], int]], counters: Counter, overlap: int) -> Iterator[dict]:
    """One chunk for each contiguous run of ``fresh``, the tail in front of the first."""
    side = state.sides[d]
    runs: list[list] = []
    for r in fresh:
        if runs and runs[-1][-1][0] + len(runs[-1][-1][1]) == r[0]:
            runs[-1].append(r)
        else:
            runs.append([r])
    for run in runs:
        joined = side.tail_start + len(side.tail) == run[0][0]
        start = side.tail_start if joined else run[0][0]
        data = (side.tail if joined else b"") + b"".join(r[1] for r in run)
        spans = (side.tail_spans if joined else []) + [{"start": r[0], "stop": r[0] + len(r[1]), "packet_ids": r[2], "time": r[3]} for r in run]
        cut, due = (side.tail_cut, side.due) if joined else (False, 0)
        # a long message's rest, and what comes behind it, are chunks of their own, so that messages are found again
        parts = [(start, data)] if not start < due < start + len(data) else [(start, data[: due - start]), (due, data[due - start :])]
        for begin, own in parts:
            at, side.tail_cut, side.due = resume(own, side.ports, overlap, counters)
            side.due = begin + side.due if side.due else due if due >= begin + len(own) else 0
            yield {
                "epoch": state.epoch, "fresh_start": max(begin, run[0][0]), "direction": d, "sport": side.ports[0], "dport": side.ports[1], "stream_offset": begin, "cut": cut and begin == start, "data": own,
                "first_timestamp_ns": min(r[3] for r in run), "last_timestamp_ns": max(r[3] for r in run), "completeness": "gapped" if side.gapped else "midstream" if side.midstream else "complete",
                "is_datagram": False, "spans": [s for s in spans if s["stop"] > begin and s["start"] < begin + len(own)], "retransmitted": 0, "conflicts": 0, "counters": dict(counters),
            }
            counters.clear()
            side.tail, side.tail_start = own[at:], begin + at
        side.tail_spans = [s for s in spans if s["stop"] > side.tail_start]


def advance(state: FlowState, rows: pd.DataFrame, settings: Settings) -> list[dict]:
    """As ``proceed``, of a frame of one flow's segments in any order."""
    return proceed(state, rows.sort_values(["timestamp_ns", "packet_id"]).itertuples(index=False), settings)


def proceed(state: FlowState, segments: Iterable, settings: Settings) -> list[dict]:
    """Chunks of the flow's new segments, which are in order: one for each direction, unless a gap or a new connection parts them.

    A SYN with another sequence number, one after a close, and a segment after
    ``flow_idle_seconds`` of rest open a new connection.
    """
    out: list[dict] = []
    counters: Counter = Counter()
    fresh: tuple[list, list] = ([], [])

    def flush(d: int) -> None:
        out.extend(_emit(state, d, fresh[d], counters, settings.overlap_bytes))
        fresh[d].clear()

    for r in segments:
        d, flags, seq, data = int(r.direction), int(r.tcp_flags), int(r.tcp_seq), bytes(r.payload)
        rests = state.last and int(r.timestamp_ns) - state.last >= settings.flow_idle_seconds * 1_000_000_000
        state.last = max(state.last, int(r.timestamp_ns))
        if rests or (flags & packets.SYN and not flags & packets.ACK and (state.closed or (state.syn[d] is not None and state.syn[d] != seq) or (state.syn[d] is None and state.sides[d].base is not None))):
            flush(0)
            flush(1)
            out += finish(state, settings, counters)
            state.begin()
        side, peer = state.sides[d], state.sides[1 - d]
        if flags & packets.ACK and peer.base is not None:
            peer.acked = max(peer.acked, peer.place(int(r.tcp_ack)) - peer.base)
        side.ports = (int(r.sport), int(r.dport))
        if flags & packets.SYN and state.syn[d] is None:
            state.syn[d] = seq
            side.base = side.reference = (1 << 32) + seq + 1
        if flags & packets.SYN:
            seq = (seq + 1) & 0xFFFFFFFF
        if data:
            if side.base is None:
                side.base, side.reference, side.midstream = (1 << 32) + seq, (1 << 32) + seq, True
            place = side.place(seq)
            side.reference = max(side.reference, place)
            start = place - side.base
            probe = len(data) == 1 and flags & packets.ACK and not flags & (packets.SYN | packets.FIN | packets.RST)
            if not (probe and start == side.next - 1 and side.acked >= side.next):  # else a keep-alive
                if start < 0:
                    data, start = data[-start:], 0
                side.waiting.append((start, data, [int(i) for i in r.source_packet_ids], int(r.timestamp_ns)))
                side.held += len(data)
        _take(side, fresh[d], counters)
        while side.waiting and (side.held > settings.max_pending_bytes or len(side.waiting) > settings.max_pending_segments):
            flush(d)
            _skip(side, counters)
            _take(side, fresh[d], counters)
        state.closed = state.closed or bool(flags & packets.RST) or (bool(flags & packets.FIN) and (side.fin or peer.fin))
        side.fin = side.fin or bool(flags & packets.FIN)
    flush(0)
    flush(1)
    if counters and out:
        out[-1]["counters"] = dict(Counter(out[-1]["counters"]) + counters)
    return out


def finish(state: FlowState, settings: Settings, counters: Counter | None = None) -> list[dict]:
    """What still waits behind gaps, at the end of a connection."""
    out: list[dict] = []
    counters = Counter() if counters is None else counters
    for d, side in enumerate(state.sides):
        while side.waiting:
            _skip(side, counters)
            fresh: list = []
            _take(side, fresh, counters)
            out += _emit(state, d, fresh, counters, settings.overlap_bytes)
    return out


def pieces(rows: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """``rows`` in order, in pieces of at most ``most`` payload bytes, or of one row."""
    ends = rows["payload"].map(len).cumsum().to_numpy()
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + most, side="right")))
        yield rows.iloc[at:stop]
        at = stop
