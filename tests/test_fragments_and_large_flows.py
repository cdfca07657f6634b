"""Fragments of ids that come back, and flows that are read in pieces, against plain versions."""

from __future__ import annotations

import random
import struct
from collections import Counter

import pytest
from test_capture import BASIC, FORM, ether, ipv4, pcap, stream, tcp

from strandscope.config import Settings
from strandscope.functions import wire
from strandscope.operators import bounded, fragments, packets
from strandscope.plans.replay import replay
from strandscope.sources import capture


def fragment(n, offset, payload, more, *, time=0, truncated=False):
    return fragments.Fragment(n, time, offset, payload, more, truncated, (n,))


def plainly(parts):
    """Outcomes of one id's fragments, by maps of bytes."""
    out, held = [], None
    for f in parts:
        held = held or {"bytes": {}, "end": None, "ids": set(), "cut": False}
        stop = f.offset + len(f.payload)
        held["cut"] |= f.truncated
        error = None
        if f.more and (not f.payload or len(f.payload) % 8):
            error = "fragment_malformed"
        elif not f.more and held["end"] not in (None, stop):
            error = "fragment_conflicting_end"
        elif any(held["bytes"].get(f.offset + i, b) != b for i, b in enumerate(f.payload)):
            error = "fragment_conflicting_overlap"
        if not error:
            held["end"] = stop if not f.more else held["end"]
            if not held["ids"] or any(f.offset + i not in held["bytes"] for i in range(len(f.payload))):
                held["ids"].add(f.packet_id)
            held["bytes"] |= {f.offset + i: b for i, b in enumerate(f.payload)}
            if held["end"] is not None and held["bytes"] and max(held["bytes"]) >= held["end"]:
                error = "fragment_conflicting_end"
            elif held["end"] is not None and len(held["bytes"]) == held["end"] and held["bytes"]:
                if held["cut"]:
                    error = "fragment_truncated"
                else:
                    out.append((bytes(held["bytes"][i] for i in range(held["end"])), None, held["ids"]))
                    held = None
        if error:
            out.append((None, error, None))
            held = None
    if held:
        out.append((None, "fragment_truncated" if held["cut"] else "fragment_incomplete", None))
    return out


def test_assemblies_against_maps_of_bytes():
    rng = random.Random(11)
    seen = Counter()
    for _ in range(3_000):
        parts = []
        for _ in range(rng.randint(1, 3)):
            data = rng.randbytes(rng.choice([3, 8, 20, 40]))
            cuts = [0, *range(8, len(data), 8), len(data)]
            own = [(a, data[a:b], b < len(data)) for a, b in zip(cuts, cuts[1:], strict=False)]
            own += [p for p in own if rng.random() < 0.2]
            rng.shuffle(own)
            parts += [p for p in own if rng.random() < 0.93]
        if rng.random() < 0.2 and parts:
            a, data, more = rng.choice(parts)
            parts.append(rng.choice([(a, bytes(len(data)), more), (a, data + b"xxxxxxxx", more), (a, data + b"xyz", True)]))
        given = [fragment(n, a, d, more, truncated=rng.random() < 0.02) for n, (a, d, more) in enumerate(parts, 1)]
        got, held = [], None
        for f in given:
            held, done = fragments.step(held, f, 10**9)
            got += done
        got += [held.lost()] if held else []
        expected = plainly(given)
        assert [(o.payload, o.error) for o in got] == [e[:2] for e in expected]
        assert [set(o.source_packet_ids) for o in got if o.payload is not None] == [e[2] for e in expected if e[2] is not None]
        seen.update(e[1] for e in expected)
    assert min(seen[k] for k in (None, "fragment_conflicting_overlap", "fragment_conflicting_end", "fragment_incomplete", "fragment_truncated", "fragment_malformed")) > 10


def test_assemblies_are_bounded_and_rest():
    held = fragments.Assembly()
    outcomes = [held.add(fragment(n, n * 16, bytes(8), True)) for n in range(fragments.MAX_RANGES + 1)]
    assert outcomes[:-1] == [None] * fragments.MAX_RANGES and outcomes[-1].error == "fragment_evicted"
    assert fragments.Assembly().add(fragment(1, fragments.MAX_DATAGRAM, b"x", False)).error == "fragment_malformed"
    held, _ = fragments.step(None, fragment(1, 0, bytes(8), True, time=0), 30)
    held, done = fragments.step(held, fragment(2, 8, b"x", False, time=30), 30)
    assert [o.error for o in done] == ["fragment_incomplete"] and held is not None


def test_an_id_is_free_when_its_datagram_is_complete(spark, tmp_path):
    """Two datagrams of one id within a second, and then one with a conflict: two come, one is counted."""

    def cut(data, ident):
        whole = struct.pack(">HHHH", 40000, 5060, 8 + len(data), 0) + data
        return [ether(ipv4(whole[a:b], protocol=17, ident=ident, offset=a, more=b < len(whole))) for a, b in ((0, 16), (16, len(whole)))]

    first, second = cut(b"a" * 30, 9), cut(b"b" * 40, 9)
    clash = [*cut(b"c" * 30, 9), ether(ipv4(b"d" * 16, protocol=17, ident=10, offset=0, more=True)), *cut(b"e" * 30, 10)]
    (tmp_path / "a.pcap").write_bytes(pcap([*first, *second[::-1], *clash]))
    rows = packets.defragment(packets.decode_datagrams(capture.read_captures(spark, str(tmp_path / "a.pcap")))).collect()
    assert sorted(bytes(r["network_payload"])[8:] for r in rows if not r["error"]) == [b"a" * 30, b"b" * 40, b"c" * 30]
    assert sorted(r["error"] for r in rows if r["error"]) == ["fragment_conflicting_overlap", "fragment_incomplete"]
    assert sorted(r["source_packet_ids"] for r in rows if not r["error"]) == [[1, 2], [3, 4], [5, 6]]


# --- large flows -------------------------------------------------------------


def conversation(rng, n):
    """A client's requests: headers with credentials, forms, files, a body too long to be read, and short ones."""
    out = b""
    for k in range(n):
        kind = rng.randrange(5)
        if kind == 0:
            out += BASIC
        elif kind == 1:
            out += FORM
        elif kind == 2:
            body = b'{"user": "u%d", "password": "p%d", "more": [1, 2]}' % (k, k)
            out += b"POST /j HTTP/1.1\r\nContent-Type: application/json\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        elif kind == 3:
            body = rng.randbytes(rng.choice([10, 3_000, 30_000])).replace(b"HTTP", b"----")
            out += b"PUT /f HTTP/1.1\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        else:
            out += b"GET /q?token=t%d&x=1 HTTP/1.1\r\nAuthorization: Bearer abc.%d\r\nCookie: sid=s%d\r\n\r\n" % (k, k, k)
    return out


def _found(spark, path, scratch, **settings):
    out = replay(spark, path, Settings(material_policy="raw", **settings), scratch)
    keys = ("detector", "material_type", "direction", "start", "stop", "material", "username", "attempt_ordinal", "completeness")
    return sorted((tuple(str(r[k]) for k in keys), tuple(r["packet_ids"])) for r in out.findings.collect()), out.chunks


def test_large_flows_give_what_whole_ones_give(spark, tmp_path):
    rng = random.Random(8)
    data = conversation(rng, 160)
    records = stream(data, cuts=sorted(rng.sample(range(1, len(data)), len(data) // 900)))
    # some come late, and some again
    for _ in range(60):
        i = rng.randrange(1, len(records) - 3)
        records[i], records[i + 2] = records[i + 2], records[i]
    records += [records[i] for i in rng.sample(range(1, len(records)), 10)]
    records += stream(b"a1 LOGIN bob secret\r\n" * 400, dport=143, sport=50001, cuts=range(100, 8_000, 333))
    (tmp_path / "a.pcap").write_bytes(pcap(records))
    whole, chunks = _found(spark, str(tmp_path / "a.pcap"), str(tmp_path / "whole"))
    assert chunks.count() == 2 and len(whole) > 300
    pieces, chunks = _found(spark, str(tmp_path / "a.pcap"), str(tmp_path / "pieces"), max_flow_bytes=2_000)
    assert chunks.count() >= 2 and pieces == whole


@pytest.mark.parametrize("piece", [1_500, 20_000, 70_000])
def test_pieces_of_any_size_frame_all_messages(piece):
    """Messages that are cut, or longer than what is read again, are framed in the end, each once."""
    from strandscope.functions import http1

    rng = random.Random(piece)
    data = conversation(rng, 120)
    starts = {m.start for m in http1.frame(data, Counter()) if m.complete and m.end - m.start < 9_000}
    settings = Settings(overlap_bytes=10_000)
    import pandas as pd

    rows = pd.DataFrame([{"direction": 0, "packet_id": n, "timestamp_ns": n, "sport": 1, "dport": 80, "tcp_seq": 1000 + a, "tcp_ack": 0, "tcp_flags": 16, "payload": data[a : a + 1_000], "source_packet_ids": [n]} for n, a in enumerate(range(0, len(data), 1_000), 1)])
    state, got, joined = bounded.FlowState(), set(), {}
    for part in bounded.pieces(rows, piece):
        for c in bounded.advance(state, part, settings):
            assert len(c["data"]) <= piece + settings.overlap_bytes + 1_000
            joined[c["fresh_start"]] = c["data"][c["fresh_start"] - c["stream_offset"] :]
            got |= {c["stream_offset"] + m.start for m in http1.frame(c["data"], Counter()) if m.complete}
    assert b"".join(joined[k] for k in sorted(joined)) == data
    assert starts <= got


def test_flows_that_rest_are_other_connections(spark, tmp_path):
    def at(seconds, records):
        return b"".join(struct.pack("<IIII", 1_700_000_000 + seconds, n, len(r), len(r)) + r for n, r in enumerate(records))

    (tmp_path / "a.pcap").write_bytes(pcap([]) + at(0, stream(BASIC)) + at(299, [tcp(BASIC, seq=1000 + len(BASIC))]) + at(700, [tcp(BASIC, seq=1000 + 2 * len(BASIC))]))
    for most in (10**6, 10):
        out = replay(spark, str(tmp_path / "a.pcap"), Settings(max_flow_bytes=most), str(tmp_path / f"s{most}"))
        rows = out.findings.orderBy("observed_timestamp_ns").collect()
        assert [(r["epoch"], r["start"] > 70, r["completeness"]) for r in rows] == [(0, False, "complete"), (0, True, "complete"), (1, False, "midstream")]


def test_gaps_in_large_flows_are_bounded_and_counted(spark, tmp_path):
    lost = [tcp(seq=999, flags=2), tcp(b"x" * 100, seq=1000), *(tcp(b"y" * 1_000, seq=2_000 + n * 1_000) for n in range(20))]
    (tmp_path / "a.pcap").write_bytes(pcap(lost))
    out = replay(spark, str(tmp_path / "a.pcap"), Settings(max_flow_bytes=1_000, max_pending_bytes=5_000), str(tmp_path / "s"))
    assert {r["name"]: r["value"] for r in out.counters.collect()}["tcp_forced_gap_bytes"] == 900
    assert sum(len(c["data"][(0 if c["stream_offset"] != 0 else 0) :]) for c in out.chunks.collect()) >= 20_100 and out.verdict.first()["verdict"] == "incomplete"


# --- where messages end ------------------------------------------------------


def test_units_end_where_messages_end():
    rng = random.Random(2)
    bind = b"\x30\x0c\x02\x01\x01\x60\x07\x02\x01\x03\x04\x00\x80\x00"
    tds = struct.pack(">BBHHBB", 0x12, 1, 8 + 5, 0, 1, 0) + b"abcde"
    query = b"Q" + struct.pack(">I", 8) + b"abc\0"
    for ports, unit in (({389}, bind), ({1433}, tds), ({5432}, query), ({6379}, b"*1\r\n$4\r\nPING\r\n"), ({6379}, b"PING\r\n")):
        data = unit * 5
        for cut in rng.sample(range(len(data) + 1), 12):
            assert wire.last_unit(data[:cut], ports) == cut // len(unit) * len(unit), (ports, cut)
    assert wire.last_unit(b"GET / HTTP/1.1", {80}) == 0 and wire.last_unit(b"", {5432}) == 0


@pytest.mark.parametrize(
    ("line", "given"),
    [
        (b'AUTH "my pass"\r\n', [("", "my pass")]),
        (b"AUTH u 'p w'\r\n", [("u", "p w")]),
        (b'AUTH "a\\x41\\"\\n"\r\n', [("", 'aA"\n')]),
        (b"HELLO 3 SETNAME AUTH AUTH u p\r\n", [("u", "p")]),
        (b"HELLO 3 AUTH u p SETNAME x\r\n", [("u", "p")]),
        (b"HELLO 3 SETNAME AUTH\r\n", []),
        (b"SET k 'v w'\r\nAUTH z\r\n", [("", "z")]),
    ],
)
def test_redis_words(line, given):
    counters = Counter()
    assert [(r.values["username"], r.values["material"]) for r in wire.redis(line, counters)] == given and not counters


def test_redis_quotes_that_stay_open_are_counted():
    counters = Counter()
    assert not list(wire.redis(b'AUTH "open\r\nAUTH x\r\n', counters)) and counters == {"coverage_cleartext_frame_boundary_lost": 1}




# --- bodies and ports --------------------------------------------------------


def upload(kind, body):
    return b"PUT /f HTTP/1.1\r\nContent-Type: " + kind + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body


@pytest.mark.parametrize(
    ("message", "kinds", "counter"),
    [
        (upload(b"application/zip", b"PK\x05\x06" + bytes(18)), ["zip"], None),
        (upload(b'multipart/form-data; boundary="a b"', b"--a b\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n\x1a\n...."), ["png"], None),
        (upload(b"multipart/form-data; boundary=ab", b"--ab\r\n\r\n%PDF-1.4 ...."), ["pdf"], None),
        (upload(b"multipart/form-data; boundary=ab", b"--cd\r\n\r\n%PDF-1.4 ...."), [], "http_transfer_multipart_prefix_unresolved"),
        (upload(b"multipart/form-data; boundary=ab", b"text\r\n\r\n%PDF-1.4 ...."), [], "http_transfer_multipart_prefix_unresolved"),
        (upload(b"multipart/form-data; boundary=ab", b"--ab\r\nX: " + b"y" * 2_100 + b"\r\n\r\n%PDF-1.4"), [], "http_transfer_multipart_prefix_unresolved"),
        (upload(b"multipart/form-data", b"%PDF-1.4 ........"), ["pdf"], None),
    ],
)
def test_parts_begin_behind_their_boundary(message, kinds, counter):
    from strandscope.functions import http1

    counters = Counter()
    assert [t["kind"] for t in http1.transfers(http1.frame(message, Counter()), counters)] == kinds
    assert list(counters) == ([counter] if counter else [])


def test_digests_on_the_port_of_sip(spark, tmp_path):
    from test_capture import udp

    digest = b'Authorization: Digest username="eve", realm="r", nonce="n", uri="sip:h", response="00"\r\n\r\n'
    (tmp_path / "a.pcap").write_bytes(pcap([udp(digest, dport=5060), udp(digest, dport=5061), udp(b"x SIP/2.0\r\n" + digest, dport=5061)]))
    out = replay(spark, str(tmp_path / "a.pcap"), Settings(material_policy="raw"), str(tmp_path / "s"))
    assert sorted(r["detector"] for r in out.findings.collect()) == ["http_digest", "sip_digest", "sip_digest"]
