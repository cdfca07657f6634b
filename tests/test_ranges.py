"""Captures in ranges of any size give the rows of a whole read, whatever packets hold."""

from __future__ import annotations

import io
import random
import struct

import pytest
from test_capture import pcap, stream

from strandscope.config import Settings
from strandscope.plans.replay import replay
from strandscope.sources import capture, ranges


def record(raw, n=0, order="<"):
    return struct.pack(order + "IIII", 1_700_000_000, n, len(raw), len(raw)) + raw


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def section(order="<"):
    return b"\x0a\x0d\x0d\x0a" + block(0, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)[4:]


def interface(link=1, order="<", snaplen=262144):
    return block(1, struct.pack(order + "HHI", link, 0, snaplen), order)


def enhanced(raw, number=0, order="<"):
    return block(6, struct.pack(order + "IIIII", number, 0, 5, len(raw), len(raw)) + raw, order)


def statistics(number, received, dropped, later=None, order="<"):
    option = lambda code, value: struct.pack(order + "HHQ", code, 8, value)
    return block(5, struct.pack(order + "III", number, 0, 0) + option(4, received) + option(5, dropped) + (b"" if later is None else option(7, later)) + bytes(4), order)


def classic(rng, order="<"):
    """Packets of random bytes, of captures, of single headers that lead to the next true record, and empty ones."""
    out = pcap([], order=order)
    for n in range(rng.randint(1, 60)):
        kind = rng.randrange(5)
        if kind == 0:
            raw = pcap([rng.randbytes(rng.randint(0, 40)) for _ in range(3)], order=order)
        elif kind == 1:
            after = rng.randint(0, 50)
            raw = rng.randbytes(rng.randint(0, 30)) + struct.pack(order + "IIII", 1, 1, after, after) + rng.randbytes(after)
        else:
            raw = rng.randbytes(rng.choice([0, 3, 60, 400, 3_000]))
        out += record(raw, n, order)
    return out


def modern(rng):
    """Sections of either byte order, interfaces that come late, statistics, simple packets, unknown blocks, and captures in packets."""
    out = b""
    for _ in range(rng.randint(1, 3)):
        order = rng.choice("<>")
        out += section(order) + interface(order=order)
        known = 1
        for _ in range(rng.randint(0, 30)):
            kind = rng.randrange(7)
            if kind == 0:
                out += interface(rng.choice([0, 12, 101]), order)
                known += 1
            elif kind == 1:
                out += statistics(rng.randrange(known), 10, 0, order=order)
            elif kind == 2:
                raw = rng.randbytes(rng.randint(0, 30))
                out += block(3, struct.pack(order + "I", len(raw)) + raw, order)
            elif kind == 3:
                out += block(0x0BAD, rng.randbytes(rng.randint(0, 40)), order)
            elif kind == 4:
                out += enhanced(section() + interface() + enhanced(b"inner"), rng.randrange(known), order)
            else:
                out += enhanced(rng.randbytes(rng.choice([0, 1, 50, 900])), rng.randrange(known), order)
    return out


def in_ranges(monkeypatch, path, content, size):
    """Rows of the planned ranges, without Spark's help."""

    def walked(_, rows):
        return {(f, k): ranges.walk(p, start, stop, length, None if forced is None else __import__("json").loads(forced)) for f, p, k, start, stop, length, forced in rows}

    monkeypatch.setattr(ranges, "_walked", walked)
    path.write_bytes(content)
    from types import SimpleNamespace

    out = []
    for r in ranges.plan(None, [(str(path), len(content))], size):
        import json

        with ranges.opened(r["path"]) as held:
            own = SimpleNamespace(**(r | {"links": json.dumps(r["links"])}))
            out += list(capture.rows_of(held, "s", "n", ranges._packets(held, own), r["number"]))
    return out


def damaged(rng, content):
    kind = rng.randrange(4)
    if kind == 0:
        return content[: rng.randrange(len(content) + 1)]
    if kind == 1 and len(content) > 40:
        at = rng.randrange(24, len(content))
        return content[:at] + rng.randbytes(4) + content[at + 4 :]
    return content


@pytest.mark.parametrize("make", [classic, lambda rng: classic(rng, ">"), modern])
def test_ranges_of_any_size(monkeypatch, tmp_path, make):
    rng = random.Random(6)
    mended = broken = 0
    for n in range(250):
        content = damaged(rng, make(rng))
        whole = list(capture.rows_of(io.BytesIO(content), "s", "n"))
        for size in (rng.choice([64, 100, 333]), rng.choice([1_000, 5_000])):
            got = in_ranges(monkeypatch, tmp_path / f"{n}-{size}.pcap", content, size)
            assert got == whole, (n, size, len(got), len(whole))
        broken += any(r[8] for r in whole)
        mended += len(whole) > 5
    assert mended > 50 and broken > 20


def test_false_beginnings_are_walked_again(monkeypatch, tmp_path):
    """A header in a packet that leads to the next true record looks like a beginning, and isn't one."""
    inner = struct.pack("<IIII", 1, 1, 20, 20) + bytes(20)
    content = pcap([]) + record(b"a" * 100) + record(b"b" * 40 + inner) + record(b"c" * 30)
    start = 24 + 116 + 16 + 30
    assert ranges.walk(str(_written(tmp_path, content)), start, len(content), len(content)).first == 24 + 116 + 16 + 40
    got = in_ranges(monkeypatch, tmp_path / "a.pcap", content, start)
    assert [r[7][:1] for r in got] == [b"a", b"b", b"c"] and [r[1] for r in got] == [1, 2, 3]


def _written(folder, content):
    (folder / "w.pcap").write_bytes(content)
    return folder / "w.pcap"


def test_long_captures_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "a.pcap").write_bytes(pcap([rng.randbytes(1_000) for _ in range(3_000)]))
    (tmp_path / "b.pcap").write_bytes(section() + interface() + b"".join(enhanced(rng.randbytes(700)) for _ in range(2_000)))
    (tmp_path / "c.pcap").write_bytes(pcap([b"short"]))
    path = str(tmp_path / "*.pcap")
    cut = capture.read_captures(spark, path, range_bytes=1 << 20)
    whole = capture.read_captures(spark, path)
    shown = lambda df: sorted((r["session_id"], r["packet_id"], r["interface"], r["timestamp_ns"], bytes(r["raw"])) for r in df.collect())
    assert shown(cut) == shown(whole) and cut.count() == 5_001
    assert cut.rdd.getNumPartitions() >= 5
    kept = capture.CaptureFilter(until_ns=1_700_000_010 * 10**9)
    assert capture.read_captures(spark, path, kept, range_bytes=1 << 20).where("session_id like '%a.pcap'").count() == 10


def test_dropped_packets_make_a_run_incomplete(spark, tmp_path):
    frames = [b"".join(enhanced(f) for f in stream(b"nothing"))]
    (tmp_path / "a.pcapng").write_bytes(section() + interface() + interface() + frames[0] + statistics(0, 9, 1) + statistics(0, 12, 3, 2) + statistics(1, 5, 0))
    (tmp_path / "b.pcapng").write_bytes(section(">") + interface(order=">") + statistics(0, 7, 0, order=">"))
    (tmp_path / "c.pcap").write_bytes(pcap([]))
    rows = capture.interface_statistics(spark, str(tmp_path)).collect()
    assert sorted((r["session_id"][-8:], r["interface"], r["received"], r["dropped"]) for r in rows) == [("a.pcapng", 0, 12, 5), ("a.pcapng", 1, 5, 0), ("b.pcapng", 0, 7, 0)]
    bad = replay(spark, str(tmp_path / "a.pcapng"), Settings(), str(tmp_path / "s1"))
    assert bad.verdict.first()["reasons"] == ["capture_dropped_packets=5"]
    assert replay(spark, str(tmp_path / "b.pcapng"), Settings(), str(tmp_path / "s2")).verdict.first()["verdict"] == "complete"
