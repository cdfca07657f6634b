"""Captures built byte by byte from the protocols' layouts, replayed end to end."""

from __future__ import annotations

import base64
import random
import struct

import pytest

from strandscope.functions import frames, http1, wire
from strandscope.operators import packets
from strandscope.plans.replay import replay
from strandscope.sources import capture

CLIENT, SERVER = "10.0.0.10", "10.0.0.20"


def ip4(address):
    return bytes(map(int, address.split(".")))


def ipv4(payload, *, src=CLIENT, dst=SERVER, protocol=6, ident=1, offset=0, more=False):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), ident, (offset // 8) | (0x2000 if more else 0), 64, protocol, 0)
    return head + ip4(src) + ip4(dst) + payload


def ether(ip, tags=()):
    return bytes(12) + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + struct.pack(">H", 0x0800) + ip


def tcp(payload=b"", *, seq=1000, sport=50000, dport=80, flags=0x18, src=CLIENT, dst=SERVER, tags=()):
    return ether(ipv4(struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 0x50, flags, 8192, 0, 0) + payload, src=src, dst=dst), tags)


def udp(payload, *, sport=40000, dport=161):
    return ether(ipv4(struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload, protocol=17))


def pcap(records, *, magic=0xA1B2C3D4, order="<", snaplen=262144):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snaplen, 1)
    for n, r in enumerate(records):
        raw, wire_length = r if isinstance(r, tuple) else (r, len(r))
        out += struct.pack(order + "IIII", 1_700_000_000 + n, n, len(raw), wire_length) + raw
    return out


def pcapng(records):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 262144))
    for n, raw in enumerate(records):
        out += block(6, struct.pack("<IIIII", 0, 0, n, len(raw), len(raw)) + raw + bytes(-len(raw) % 4))
    return out


def stream(data, *, cuts=(), seq=1000, **more):
    """A SYN and segments of ``data`` cut at the given places."""
    edges = [0, *sorted(cuts), len(data)]
    return [tcp(seq=seq - 1, flags=2, **more), *(tcp(data[a:b], seq=seq + a, **more) for a, b in zip(edges, edges[1:], strict=False) if a < b)]


BASIC = b"GET /x HTTP/1.1\r\nHost: h\r\nAuthorization: Basic " + base64.b64encode(b"alice:wonder") + b"\r\n\r\n"
FORM = b"POST /login HTTP/1.1\r\nContent-Type: application/x-www-form-urlencoded\r\nContent-Length: 33\r\n\r\nusername=bob&password=s3cret%21pw"


def run(spark, tmp_path, content, name="a.pcap", **settings):
    from strandscope.config import Settings

    (tmp_path / name).write_bytes(content)
    out = replay(spark, str(tmp_path / name), Settings(material_policy="raw", **settings), str(tmp_path / f"scratch-{name}"))
    return out.findings.collect(), out.verdict.first()


# --- sources -----------------------------------------------------------------


@pytest.mark.parametrize(("magic", "order", "unit"), [(0xA1B2C3D4, "<", 1000), (0xA1B2C3D4, ">", 1000), (0xA1B23C4D, "<", 1), (0xA1B23C4D, ">", 1)])
def test_classic_formats(magic, order, unit):
    import io

    got = list(capture.packets(io.BytesIO(pcap([b"abc", b"defg"], magic=magic, order=order))))
    assert [(g[2], g[4]) for g in got] == [(1_700_000_000 * 10**9, b"abc"), (1_700_000_001 * 10**9 + unit, b"defg")]


def test_broken_files_end_with_an_error(spark, tmp_path):
    (tmp_path / "cut.pcap").write_bytes(pcap([b"abc", b"defg"])[:-2])
    (tmp_path / "odd.pcap").write_bytes(b"hello world")
    (tmp_path / "new.pcap").write_bytes(pcapng([b"abc", b"defgh"]))
    rows = capture.read_captures(spark, str(tmp_path / "*.pcap")).collect()
    errors = {r["interface"]: r["error"] for r in rows if r["error"]}
    assert errors == {"pcap:cut.pcap": "truncated_record", "pcap:odd.pcap": "unknown_capture_format"}
    assert sorted(bytes(r["raw"]) for r in rows if not r["error"]) == [b"abc", b"abc", b"defgh"]


def test_data_source_reads_the_same(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([b"abc", b"d"]))
    capture.register(spark)
    assert [bytes(r["raw"]) for r in spark.read.format("capture").load(str(tmp_path)).orderBy("packet_id").collect()] == [b"abc", b"d"]


# --- decoding ----------------------------------------------------------------


def test_frames():
    d = frames.datagram(tcp(b"hi", tags=(5, 7)), 1, 100)
    assert (d.src, d.dst, d.vlans, d.truncated) == (CLIENT, SERVER, (5, 7), True)
    assert frames.segment(6, d.payload).payload == b"hi"
    v6 = struct.pack(">IHBB", 6 << 28, 8 + 8 + 3, 0, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + bytes([17, 0]) + bytes(6) + struct.pack(">HHHH", 1, 2, 11, 0) + b"xyz"
    d = frames.datagram(v6, 12, len(v6))
    assert (d.src, d.protocol, frames.segment(17, d.payload).payload) == ("::1", 17, b"xyz")
    assert frames.datagram(bytes(12) + b"\x08\x06" + bytes(28), 1, 42) is None
    with pytest.raises(frames.FrameError, match="vlan_depth"):
        frames.datagram(tcp(tags=range(9)), 1, 100)


def test_random_bytes_never_raise_anything_else():
    from collections import Counter

    rng = random.Random(20)
    for _ in range(1500):
        raw = rng.randbytes(rng.randint(0, 90))
        for link in (0, 1, 12, 113, 276):
            try:
                d = frames.datagram(raw, link, len(raw))
                if d:
                    frames.segment(d.protocol, d.payload)
            except frames.FrameError:
                pass
        for parser in (wire.ldap, wire.snmp, wire.kerberos, wire.tds, wire.ntlm_raw, wire.postgres_server):
            list(parser(raw))
        list(wire.redis(raw, Counter())), list(wire.postgres_client(raw, Counter())), list(wire.line_protocols(raw, {21}, True))
        http1.frame(raw, Counter())


def test_fragments():
    part = lambda i, at, data, more: (i, at, data, more, False)
    assert packets.join_fragments([part(2, 8, b"end", False), part(1, 0, b"01234567", True)]) == (b"01234567end", None)
    assert packets.join_fragments([part(1, 0, b"01234567", True), part(2, 0, b"01234567", True), part(3, 8, b"x", False)])[0] == b"01234567x"
    assert packets.join_fragments([part(1, 0, b"01234567", True), part(2, 0, b"0123456X", True), part(3, 8, b"x", False)])[1] == "fragment_conflicting_overlap"
    assert packets.join_fragments([part(1, 0, b"01234567", True)])[1] == "fragment_incomplete"
    assert packets.join_fragments([part(1, 8, b"x", False), part(2, 8, b"xy", False)])[1] == "fragment_conflicting_end"


def test_fragments_in_any_order_and_repeated():
    rng = random.Random(4)
    for _ in range(100):
        whole = bytes(rng.choices(b"ab", k=rng.randint(9, 90)))
        edges = [0, *sorted(rng.sample(range(8, len(whole), 8), rng.randint(1, (len(whole) - 1) // 8))), len(whole)]
        parts = [(a, whole[a:b], b < len(whole), False) for a, b in zip(edges, edges[1:], strict=False)]
        parts += [(0, whole[:16], len(whole) > 16, False), rng.choice(parts)]
        rng.shuffle(parts)
        assert packets.join_fragments([(n, *p) for n, p in enumerate(parts)]) == (whole, None)


def test_ranges_hold_the_first_bytes_of_each_place():
    """Against a map from place to byte, whatever order ranges come in and however they overlap."""
    rng = random.Random(5)
    for _ in range(300):
        side, first, repeated = packets.Direction(), {}, 0
        side.open(99)
        for n in range(rng.randint(1, 25)):
            at, data = rng.randrange(60), bytes(rng.choices(b"ab", k=rng.randint(1, 12)))
            repeated += sum(at + i in first for i in range(len(data)))
            for i, b in enumerate(data, at):
                first.setdefault(i, b)
            side.add(100 + at, data, [n], n)
            assert side.reached == next(i for i in range(100) if i not in first)
        held = [(a + i, b) for a, _, data, *_ in side.ranges for i, b in enumerate(data)]
        assert held == sorted(first.items()) and side.repeated == repeated


def test_single_bytes_of_a_long_session_are_read_in_linear_time():
    import time

    import pandas as pd

    n = 100_000
    rows = pd.DataFrame({"direction": 0, "packet_id": range(n), "timestamp_ns": range(n), "sport": 1024, "dport": 23, "tcp_seq": range(1000, 1000 + n), "tcp_ack": 0, "tcp_flags": 0x18, "payload": [b"k"] * n, "source_packet_ids": [[i] for i in range(n)]})
    began = time.monotonic()
    (chunk,) = packets.reassemble_flow(rows)
    assert chunk["data"] == b"k" * n and time.monotonic() - began < 30



# --- streams -----------------------------------------------------------------


def test_split_reordered_and_repeated_segments_give_the_same(spark, tmp_path):
    data = BASIC + FORM
    rng = random.Random(7)
    want = None
    for n in range(4):
        cuts = [] if n == 0 else sorted(rng.sample(range(1, len(data)), 12))
        frames_ = stream(data, cuts=cuts)
        head, rest = frames_[0], frames_[1:]
        if n > 1:
            rest += rng.sample(rest, 4)
            rng.shuffle(rest)
        found, verdict = run(spark, tmp_path, pcap([head, *rest]), f"{n}.pcap")
        got = sorted((r["detector"], r["start"], r["stop"], r["material"], r["username"], r["attempt_ordinal"]) for r in found)
        want = want or got
        assert got == want and verdict["verdict"] == "complete"
    assert ("sensitive_field", "s3cret!pw", "bob") in {(g[0], g[3], g[4]) for g in want}
    assert ("http_basic", "alice:wonder", "alice") in {(g[0], g[3], g[4]) for g in want}


def test_repeated_attempts_are_separate_and_epochs_restart(spark, tmp_path):
    records = stream(BASIC + BASIC) + [tcp(seq=9000, flags=4)] + stream(BASIC, seq=70_000)
    found, _ = run(spark, tmp_path, pcap(records))
    assert sorted((r["epoch"], r["attempt_ordinal"]) for r in found if r["detector"] == "http_basic") == [(0, 1), (0, 2), (1, 1)]
    assert all(r["packet_ids"] and r["packet_ids_complete"] for r in found)


def test_gaps_and_truncation_make_a_run_incomplete(spark, tmp_path):
    records = stream(BASIC, cuts=[20, 30])
    found, verdict = run(spark, tmp_path, pcap(records[:2] + records[3:]), "gap.pcap")
    assert verdict["verdict"] == "incomplete" and any("gapped" in r for r in verdict["reasons"])
    _, verdict = run(spark, tmp_path, pcap([(f, len(f) + 9) for f in stream(BASIC)]), "cut.pcap")
    assert any("truncated" in r for r in verdict["reasons"])


def test_sequence_wrap_and_midstream(spark, tmp_path):
    found, verdict = run(spark, tmp_path, pcap(stream(BASIC, cuts=[40], seq=0xFFFFFFF0)), "wrap.pcap")
    assert [r["detector"] for r in found if r["protocol"] == "http"] == ["http_basic"] and verdict["verdict"] == "complete"
    found, _ = run(spark, tmp_path, pcap(stream(BASIC)[1:]), "mid.pcap")
    assert {r["completeness"] for r in found} == {"midstream"}


def test_line_and_binary_protocols(spark, tmp_path):
    ber = lambda tag, body: bytes([tag, len(body)]) + body
    bind = ber(0x30, ber(2, b"\1") + ber(0x60, ber(2, b"\3") + ber(4, b"cn=admin") + ber(0x80, b"hunter2")))
    community = ber(0x30, ber(2, b"\1") + ber(4, b"private") + ber(0xA0, b"\2\1\0"))
    records = stream(b"USER carol\r\nPASS one\r\nPASS two\r\n", dport=21) + stream(bind, dport=389, sport=50001) + [udp(community)]
    records += stream(b"*2\r\n$4\r\nAUTH\r\n$5\r\nredpw\r\n*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$12\r\nAUTH secret!\r\n", dport=6379, sport=50002)
    records += stream(b"EHLO x\r\nAUTH LOGIN\r\n" + base64.b64encode(b"dave") + b"\r\n" + base64.b64encode(b"mailpw") + b"\r\n", dport=25, sport=50003)
    records += stream(b"\0\0\0\x08\0\3\0\0p\0\0\0\x0apgpwd\0", dport=5432, sport=50004) + stream(b"R\0\0\0\x08\0\0\0\3", sport=5432, dport=50004, src=SERVER, dst=CLIENT)
    found, _ = run(spark, tmp_path, pcap(records))
    got = {(r["detector"], r["username"] or "", r["material"]) for r in found}
    assert {("ftp_user_pass", "carol", "one"), ("ftp_user_pass", "carol", "two"), ("ldap_simple_bind", "cn=admin", "hunter2"), ("redis_auth", "", "redpw"), ("smtp_auth_login", "dave", "mailpw"), ("postgres_cleartext_password", "", "pgpwd")} <= got
    assert ("snmp_community", "", "private") in got and not any("secret!" in m for d, _, m in got if d == "redis_auth")


def test_postgres_log_ins_that_succeed(spark, tmp_path):
    records = []
    for n, methods in enumerate(([3, 0], [3], [5, 0], [0], [])):
        client = b"\0\0\0\x08\0\3\0\0" + b"p" + struct.pack(">I", 9) + b"pgp%d\0" % n
        server = b"".join(b"R" + struct.pack(">II", 8, m) for m in methods) + b"Z\0\0\0\5I"
        records += stream(client, dport=5432, sport=50010 + n) + stream(server, sport=5432, dport=50010 + n, src=SERVER, dst=CLIENT)
    found, _ = run(spark, tmp_path, pcap(records), "pg.pcap")
    got = {(r["detector"], r["material"], r["confidence"]) for r in found if r["detector"].startswith("postgres")}
    assert got == {("postgres_cleartext_password", "pgp0", "confirmed"), ("postgres_cleartext_password", "pgp1", "confirmed"), ("postgres_password_message", "pgp4", "medium")}


def challenge(n=1):
    return b"NTLMSSP\0" + struct.pack("<I", 2) + bytes(12) + bytes([n] * 8) + bytes(16)


def response(user="eve"):
    name = user.encode("utf-16le")
    nt = bytes(16) + b"\1\1\0\0" + bytes(40)
    at, body = 64, b""
    parts = []
    for value in (bytes(24), nt, b"", name, b"", b""):
        parts.append(struct.pack("<HHI", len(value), len(value), at + len(body)))
        body += value
    return b"NTLMSSP\0" + struct.pack("<I", 3) + b"".join(parts) + struct.pack("<I", 1) + body


@pytest.mark.parametrize(("case", "pairs"), [("plain", 1), ("missing", 0), ("other flow", 0), ("same direction", 0)])
def test_challenge_response_pairing(spark, tmp_path, case, pairs):
    back = {"sport": 445, "dport": 50000, "src": SERVER, "dst": CLIENT}
    if case == "other flow":
        back["dport"] = 50009
    if case == "same direction":
        back = {"dport": 445}
    records = ([] if case == "missing" else stream(challenge(), **back)) + stream(response(), dport=445, **({"seq": 1000 + len(challenge())} if case == "same direction" else {}))
    if case == "same direction":
        records.pop(2)  # one connection: no second SYN
    found, _ = run(spark, tmp_path, pcap(records), f"{case}.pcap")
    assert [(r["material_type"], r["username"]) for r in found if r["detector"].endswith("correlation")] == [("netntlmv2", "eve")] * pairs


def test_redacted_by_default_and_manifest_holds(spark, tmp_path):
    from strandscope import cli

    (tmp_path / "a.pcap").write_bytes(pcap(stream(BASIC)))
    assert cli.main(["replay", str(tmp_path / "a.pcap"), str(tmp_path / "out")]) == 0
    rows = spark.read.json(str(tmp_path / "out/findings")).collect()
    assert rows and all("material" not in r.asDict() and "wonder" not in str(r) for r in rows)
    assert cli.main(["validate", str(tmp_path / "out")]) == 0
    assert cli.main(["report", str(tmp_path / "out"), "--detector", "http_basic"]) == 0


# --- HTTP --------------------------------------------------------------------


def test_chunked_bodies_map_to_the_wire():
    from collections import Counter

    raw = b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\nContent-Type: application/x-www-form-urlencoded\r\n\r\n5\r\npassw\r\n8\r\nord=abcd\r\n0\r\n\r\n"
    (m,) = http1.frame(raw, Counter())
    (f,) = http1.form_fields(m.body)
    a, b = m.wire(f.start, f.stop)
    assert (f.name, f.value, raw[a:b], m.end) == ("password", "abcd", b"abcd", len(raw))


def test_ambiguous_framing_blocks_and_counts():
    from collections import Counter

    counters = Counter()
    head = b"POST / HTTP/1.1\r\nContent-Length: 1\r\nContent-Length: 2\r\n\r\nab"
    assert http1.frame(head, counters) == [] and counters == {"http_framed_requests": 1, "http_framing_ambiguous": 1} or counters["http_framing_ambiguous"] == 1


def test_json_and_files():
    from collections import Counter

    assert [(f.name, f.value) for f in http1.json_fields(b'{"a": {"password": "x"}, "n": [{"password": 5}], "t": true}')] == [("password", "x"), ("password", "5")]
    body = b"\x89PNG\r\n\x1a\n" + bytes(20)
    raw = b"HTTP/1.1 200 OK\r\nContent-Type: image/jpeg\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    (t,) = http1.transfers(http1.frame(raw, Counter()), Counter())
    assert (t["kind"], t["mismatch"], raw[t["start"] : t["start"] + 4]) == ("png", True, b"\x89PNG")


# --- exchanges ---------------------------------------------------------------

BACK = {"sport": 445, "dport": 50000, "src": SERVER, "dst": CLIENT}


def smb(token, session):
    head = b"\xfeSMB\x40\x00" + bytes(34) + struct.pack("<Q", session) + bytes(16)
    return struct.pack(">I", len(head) + len(token)) + head + token


def exchange(parts, port):
    """One connection in which both sides speak in turns: (from the server, bytes)."""
    at = {False: 1000, True: 5000}
    ends = {False: {"sport": port, "dport": 445}, True: BACK | {"dport": port}}
    records = [tcp(seq=999, flags=2, **ends[False]), tcp(seq=4999, flags=18, **ends[True])]
    for back, data in parts:
        records.append(tcp(data, seq=at[back], **ends[back]))
        at[back] += len(data)
    return records


# what is sent, and whose responses have a challenge
EXCHANGES = {
    "goes-on": ([(True, challenge(1)), (False, "a"), (True, b"OK")], "a"),
    "in-turn": ([(True, challenge(1)), (False, "a"), (True, b"no"), (True, challenge(2)), (False, "b"), (True, b"OK")], "ab"),
    "once": ([(True, challenge(1)), (False, "a"), (False, "b")], "a"),
    "late": ([(False, "a"), (True, challenge(1))], ""),
    "sessions": ([(True, smb(challenge(1), 7)), (True, smb(challenge(2), 9)), (False, "b", 9), (False, "a", 7), (True, b"x")], "ab"),
    "other": ([(True, smb(challenge(1), 7)), (False, "a", 8)], ""),
    "zero": ([(True, smb(challenge(1), 0)), (False, "a", 0), (True, smb(challenge(2), 0)), (False, "b", 0)], "ab"),
    "shared-zero": ([(True, smb(challenge(1), 0)), (True, smb(challenge(2), 0)), (False, "a", 0)], ""),
}


def test_exchanges_pair_in_order(spark, tmp_path):
    records, want = [], set()
    for n, (case, (parts, paired)) in enumerate(EXCHANGES.items()):
        sent = []
        for back, data, *session in parts:
            token = data if back else response(f"{case}-{data}")
            sent.append((back, smb(token, *session) if session else token))
        records += exchange(sent, 50_000 + n)
        want |= {f"{case}-{name}" for name in paired}
    found, _ = run(spark, tmp_path, pcap(records), "x.pcap")
    assert sorted(r["username"] for r in found if r["detector"].endswith("correlation")) == sorted(want)


def acked(payload, *, seq, ack, **more):
    raw = bytearray(tcp(payload, seq=seq, flags=0x10, **more))
    raw[42:46] = struct.pack(">I", ack)
    return bytes(raw)


def test_keep_alives_only_if_acknowledged():
    import pandas as pd

    def flow(acknowledged):
        rows = [(0, 1, 999, 0, 2, b""), (0, 2, 1000, 0, 0x18, b"abcd"), *([(1, 3, 5000, 1004, 0x10, b"")] if acknowledged else []), (0, 4, 1003, 5000, 0x10, b"Z")]
        rows = [(1, 0, 4999, 1000, 18, b""), *rows]
        return pd.DataFrame([{"direction": d, "packet_id": n, "timestamp_ns": n, "sport": 1, "dport": 2, "tcp_seq": s, "tcp_ack": a, "tcp_flags": f, "payload": p, "source_packet_ids": [n]} for d, n, s, a, f, p in rows])

    for acknowledged, conflicts in ((True, 0), (False, 1)):
        (chunk,) = packets.reassemble_flow(flow(acknowledged))
        assert chunk["data"] == b"abcd" and chunk["conflicts"] == conflicts


def test_a_byte_below_a_gap_is_data():
    """One unacknowledged byte in front of what is expected is a byte of the stream, not a probe."""
    import pandas as pd

    rows = [(0, 1, 999, 2, b""), (0, 2, 1001, 0x18, b"bc"), (0, 3, 1000, 0x18, b"a")]
    frame_ = pd.DataFrame([{"direction": d, "packet_id": n, "timestamp_ns": n, "sport": 1, "dport": 2, "tcp_seq": s, "tcp_ack": 0, "tcp_flags": f, "payload": p, "source_packet_ids": [n]} for d, n, s, f, p in rows])
    (chunk,) = packets.reassemble_flow(frame_)
    assert chunk["data"] == b"abc"


def test_a_failing_parser_does_not_end_the_others(spark, tmp_path, monkeypatch):
    from collections import namedtuple

    from strandscope.operators import detect_stream

    def broken(data):
        raise RecursionError
        yield

    monkeypatch.setattr(wire, "ldap", broken)
    names = "session_id flow_id epoch direction sport dport stream_offset data last_timestamp_ns completeness is_datagram spans"
    chunk = namedtuple("chunk", names)("s", "f", 0, 0, 50000, 8443, 0, challenge(), 1, "complete", False, [])
    parts = list(detect_stream._parts_of(chunk, 1000))
    assert {p.get("counter") for p in parts} >= {"parser_error:ldap"} and any(p.get("detector") == "ntlm_type2_challenge" for p in parts)


def test_every_parser_is_isolated(monkeypatch):
    from collections import namedtuple

    from strandscope.operators import detect_stream

    def broken(*_, **__):
        raise RecursionError

    names = "session_id flow_id epoch direction sport dport stream_offset data last_timestamp_ns completeness is_datagram spans"
    chunk = namedtuple("chunk", names)("s", "f", 0, 0, 50000, 21, 0, b"USER a\r\nPASS b\r\n" + challenge(), 1, "complete", False, [])
    for name, module, function in (("http_framing", http1, "frame"), ("http_transfers", http1, "transfers"), ("line_protocols", wire, "line_protocols")):
        with monkeypatch.context() as patch:
            patch.setattr(module, function, broken)
            parts = list(detect_stream._parts_of(chunk, 1000))
        assert f"parser_error:{name}" in {p.get("counter") for p in parts} and any(p.get("detector") == "ntlm_type2_challenge" for p in parts)


def test_line_gate_is_a_superset():
    from strandscope.operators import detect_stream

    rng = random.Random(11)
    words = [b"USER", b"pass", b"NICK", b"login:", b"logon =", b"a1 LOGIN", b"AUTH PLAIN", b"x AUTHENTICATE LOGIN", b"passcode:", b"hello", b"AGEAYg==", b"bob", b"JOIN", b"\r\n", b"\n", b" "]
    for _ in range(3_000):
        data = b" ".join(rng.choices(words, k=rng.randint(1, 8))) + b"\r\n"
        ports = {rng.choice((21, 23, 25, 80, 6667))}
        if list(wire.line_protocols(data, ports, True)):
            assert detect_stream.may_have_lines(data, ports)


def test_postgres_methods_before_each_password(spark, tmp_path):
    """Two log-ins of one connection: the first is asked for a hash, the second for the password itself."""
    ask = lambda m: b"R" + struct.pack(">II", 8, m)
    say = lambda p: b"p" + struct.pack(">I", 5 + len(p)) + p + b"\0"
    first = b"\0\0\0\x08\0\3\0\0"
    to, back = {"sport": 50030, "dport": 5432}, {"sport": 5432, "dport": 50030, "src": SERVER, "dst": CLIENT}
    at, their, records = 1000, 1000, [tcp(seq=999, flags=2, **to), tcp(seq=999, flags=18, **back)]
    for from_client, data in ((True, first), (False, ask(5)), (True, say(b"md5hash")), (False, ask(3)), (True, say(b"clear")), (False, ask(0))):
        records.append(tcp(data, seq=at if from_client else their, **(to if from_client else back)))
        at, their = at + len(data) * from_client, their + len(data) * (not from_client)
    found, _ = run(spark, tmp_path, pcap(records), "pg2.pcap")
    assert [(r["detector"], r["material"]) for r in found if r["detector"].startswith("postgres")] == [("postgres_cleartext_password", "clear")]


def test_fragment_ids_that_come_back(spark):
    """An id used again after the idle time is another datagram."""
    body = struct.pack(">HHHH", 40000, 161, 8 + 16, 0) + bytes(16)
    parts = [ether(ipv4(body[a:b], protocol=17, ident=7, offset=a, more=b < 24)) for a, b in ((0, 8), (8, 24))]
    rows = [("s", n + 1, at * 1_000_000_000, "i", 1, len(raw), len(raw), raw, None) for n, (at, raw) in enumerate([(0, parts[0]), (1, parts[1]), (50, parts[1]), (51, parts[0]), (99, parts[0])])]
    whole = packets.defragment(packets.decode_datagrams(spark.createDataFrame(rows, capture.SCHEMA))).collect()
    assert sorted((r["source_packet_ids"], r["error"]) for r in whole) == [([1, 2], None), ([3, 4], None), ([5], "fragment_incomplete")]


def test_sources_filter_packets(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(stream(BASIC, cuts=[10, 20, 30])))
    (tmp_path / "b.pcap").write_bytes(pcap(stream(BASIC))[:-1])
    times = [1_700_000_000_000_000_000 + n * 1_000_001_000 for n in range(5)]
    want = {("a.pcap", 2), ("a.pcap", 3), ("b.pcap", None)}  # the broken file still tells
    names = lambda rows: {(r["session_id"].rsplit("/", 1)[1], r["packet_id"]) for r in rows.collect()}
    kept = capture.CaptureFilter(since_ns=times[1], until_ns=times[3], datalinks=frozenset([1, 113]))
    assert names(capture.read_captures(spark, str(tmp_path), kept)) == want
    capture.register(spark)
    source = spark.read.format("capture").option("sinceNs", times[1]).option("untilNs", times[3])
    assert names(source.option("datalinks", "1,113").load(str(tmp_path))) == want
    assert names(source.option("datalinks", "12").load(str(tmp_path))) == {("b.pcap", None)}


def test_failing_captures_are_named(spark, tmp_path):
    from strandscope.config import Settings

    bad = ether(b"\x45" + bytes(3))
    (tmp_path / "bad.pcap").write_bytes(pcap([bad] * 6 + stream(BASIC)))
    reasons = lambda **s: replay(spark, str(tmp_path / "bad.pcap"), Settings(**s), str(tmp_path / f"s{s['error_floor']}")).reasons.collect()
    assert [r["reason"].split(":")[0] for r in reasons(error_floor=6)] == ["decode_errors"] and reasons(error_floor=7) == []


def test_preflight(spark, tmp_path, capsys):
    from strandscope import cli, preflight

    (tmp_path / "a.pcap").write_bytes(pcap(stream(b"nothing here", dport=9000)))
    (tmp_path / "short.pcap").write_bytes(b"abc")
    assert cli.main(["doctor", str(tmp_path / "a.pcap"), str(tmp_path / "out")]) == 0
    assert cli.main(["doctor", str(tmp_path / "none.pcap"), str(tmp_path / "out")]) == 2
    assert cli.main(["doctor", str(tmp_path / "*.pcap"), str(tmp_path / "out")]) == 2 and "not_a_capture" in capsys.readouterr().out
    assert cli.main(["replay", str(tmp_path / "a.pcap"), str(tmp_path / "out")]) == 0
    assert cli.main(["validate", str(tmp_path / "out")]) == 0 and cli.main(["report", str(tmp_path / "out")]) == 0  # no findings
    (tmp_path / "out").chmod(0o755)
    assert cli.main(["validate", str(tmp_path / "out")]) == 1
    (tmp_path / "link").symlink_to(tmp_path / "out")
    assert [p.split(":")[0] for p in preflight.claim(str(tmp_path / "link"))] == ["link"]
    assert preflight.exposed("s3a://bucket/out") == []


def test_json_lines_show_bytes(spark):
    from strandscope.operators import emit

    rows = spark.createDataFrame([(bytearray(b"\xff\0a"), "x", [1])], "raw binary, text string, ids array<int>")
    assert rows.select(emit.json_line(rows)).first()[0] == '{"ids":[1],"raw":{"encoding":"hex","data":"ff0061"},"text":"x"}'
