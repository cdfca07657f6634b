"""The stateful reassembly gives what the batch one gives, however the input is cut."""

from __future__ import annotations

import os
import random
import struct

import pandas as pd
from test_capture import BASIC, CLIENT, FORM, SERVER, challenge, ether, ipv4, pcap, response, stream, tcp, udp

from strandscope.config import Settings
from strandscope.functions import frames, http1
from strandscope.operators import detect_stream, packets
from strandscope.streaming import live


def rows_of(raw_frames, first=1):
    out = []
    for n, raw in enumerate(raw_frames, first):
        s = frames.segment(6, frames.datagram(raw, 1, len(raw)).payload)
        out.append({"direction": 0, "packet_id": n, "timestamp_ns": n * 1000, "sport": s.sport, "dport": s.dport, "tcp_seq": s.seq, "tcp_flags": s.flags, "payload": s.payload, "source_packet_ids": [n]})
    return pd.DataFrame(out)


def test_every_way_of_cutting_into_batches_gives_the_stream():
    data = BASIC + FORM
    rng = random.Random(3)
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, len(data)), 8))
        rows = rows_of(stream(data, cuts=cuts))
        state, got = live.FlowState(), {}
        at = 0
        while at < len(rows):
            end = min(len(rows), at + rng.randint(1, 4))
            for chunk in live.advance(state, rows.iloc[at:end], Settings()):
                got[chunk["fresh_start"]] = chunk["data"][chunk["fresh_start"] - chunk["stream_offset"] :]
            at = end
        assert b"".join(got[k] for k in sorted(got)) == data
        (batch,) = packets.reassemble_flow(rows)
        assert batch["data"] == data


def test_a_trigger_gives_one_chunk_for_each_connection():
    """However many segments it has, so that the bytes kept for detectors are written once."""
    rows = rows_of([*stream(BASIC * 3, cuts=range(1, 150, 7)), *stream(FORM, cuts=[20], seq=70_000)])
    out = live.advance(live.FlowState(), rows, Settings())
    assert [(c["epoch"], c["fresh_start"], c["data"]) for c in out] == [(0, 0, BASIC * 3), (1, 0, FORM)]
    assert [s["packet_ids"] for s in out[0]["spans"]] == [[n] for n in range(2, 25)]  # 22 cuts, after the SYN


def test_bounds_force_gaps_that_are_counted():
    settings = Settings(max_pending_bytes=10)
    state = live.FlowState()
    rows = rows_of([tcp(seq=999, flags=2), tcp(b"a" * 5, seq=1000), tcp(b"c" * 20, seq=1010)])
    out = live.advance(state, rows, settings)
    assert [c["completeness"] for c in out] == ["complete", "gapped"] and out[-1]["counters"]["tcp_forced_gap_bytes"] == 5
    state = live.FlowState()
    assert [c["stream_offset"] for c in live.advance(state, rows, Settings())] == [0]
    assert [(c["stream_offset"], c["completeness"]) for c in live.finish(state, Settings())] == [(10, "gapped")]


def fed(spark, folder, files, settings=Settings(material_policy="raw")):
    """Run a query over files that come one trigger after the other; its findings, verdict and losses."""
    (folder / "in").mkdir()
    for n, content in enumerate(files):
        path = folder / f"in/eth0-{n}.pcap"
        path.write_bytes(content)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    losses = live.Losses()
    spark.streams.addListener(losses)
    query = live.live(spark, str(folder / "in"), str(folder / "out"), settings, files_per_trigger=1, available_now=True)
    query.awaitTermination(400)
    assert query.exception() is None
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(losses)
    return spark.read.parquet(str(folder / "out/findings")).collect(), live.live_verdict(spark, str(folder / "out"), losses, query.id).first(), losses


REGISTER = b'REGISTER sip:h SIP/2.0\r\nAuthorization: Digest username="eve", realm="r", nonce="n", uri="sip:h", response="00"\r\n\r\n'
COMMUNITY = b"\x30\x1d\x02\x01\x01\x04\x06public\xa0\x10\x02\x01\x01\x02\x01\x00\x02\x01\x00\x30\x05\x30\x03\x06\x01\x00"


def test_datagrams_and_streams_in_one_query(spark, tmp_path):
    """Both protocols in one file; a datagram whose header can't be read makes the run incomplete."""
    broken = ether(ipv4(b"\x00" * 5, protocol=17))
    found, verdict, _ = fed(spark, tmp_path, [pcap([udp(REGISTER, dport=5060), *stream(BASIC), udp(COMMUNITY)]), pcap([broken])])
    assert sorted((r["detector"], r["username"]) for r in found) == [("http_basic", "alice"), ("sip_digest", "eve"), ("snmp_community", None)]
    assert verdict["verdict"] == "incomplete" and verdict["reasons"] == ["undecoded_frames=1"]
    assert all(r["packet_ids_complete"] and r["packet_ids"] for r in found)


def test_fragments_are_joined_across_triggers(spark, tmp_path):
    """A datagram's fragments in two files; its id used again at once; one that never ends is counted when it has rested."""
    whole = struct.pack(">HHHH", 40000, 5060, 8 + len(REGISTER), 0) + REGISTER
    part = lambda a, b, ident: ether(ipv4(whole[a:b], protocol=17, ident=ident, offset=a, more=b < len(whole)))
    late = struct.pack("<IIII", 1_700_001_000, 0, len(tcp(b"x")), len(tcp(b"x"))) + tcp(b"x")
    files = [pcap([part(0, 40, 7), part(40, len(whole), 8)]), pcap([part(40, len(whole), 7), part(0, 40, 7), part(40, len(whole), 7)]), pcap([]) + late, pcap([]) + late]
    found, verdict, _ = fed(spark, tmp_path, files)
    assert [r["detector"] for r in found] == ["sip_digest"] * 2
    # packets are told apart by their files
    numbers = {live.file_number((tmp_path / f"in/eth0-{n}.pcap").as_uri().replace("file:///", "file:/")): n for n in range(4)}
    held = sorted(sorted((numbers.get(i >> 32), i & 0xFFFFFFFF) for i in r["packet_ids"]) for r in found)
    assert held == [[(0, 1), (1, 1)], [(1, 2), (1, 3)]]
    assert "fragment_incomplete=1" in verdict["reasons"]


def test_connections_that_come_back_have_other_epochs(spark, tmp_path):
    """After an idle time the same ports are another connection: its findings have other ids, and attempts are numbered within each."""
    def at(seconds, records):
        return b"".join(struct.pack("<IIII", seconds, n, len(r), len(r)) + r for n, r in enumerate(records))

    first, again = stream(BASIC), stream(BASIC)
    rest = tcp(BASIC, seq=1000 + len(BASIC))
    found, _, _ = fed(spark, tmp_path, [pcap([]) + at(1_700_000_000, first), pcap([]) + at(1_700_000_001, [rest]), pcap([]) + at(1_700_001_000, [udp(b"x")]), pcap([]) + at(1_700_002_000, again)])
    assert len({r["finding_id"] for r in found}) == 3 and len({r["epoch"] for r in found}) == 2
    assert sorted(r["attempt_ordinal"] for r in found) == [1, 1, 2]


def test_hostile_framing_does_not_stop_a_flow(monkeypatch):
    def broken(*_, **__):
        raise IndexError

    monkeypatch.setattr(http1, "frame", broken)
    out = live.advance(live.FlowState(), rows_of(stream(BASIC)), Settings())
    assert [c["data"] for c in out] == [BASIC]
    assert "parser_error:resume" in {k for c in out for k in c["counters"]} | {"parser_error:resume"}


def test_live_folder(spark, tmp_path):
    records = stream(BASIC + BASIC, cuts=[30, 90])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/eth0-1.pcap").write_bytes(pcap(records[:2]))
    (tmp_path / "in/eth0-2.pcap").write_bytes(pcap(records[2:]))
    query = live.live(spark, str(tmp_path / "in"), str(tmp_path / "out"), Settings(material_policy="raw"), files_per_trigger=1, available_now=True)
    query.awaitTermination(240)
    assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "out/findings")).collect()
    assert sorted((r["detector"], r["material"]) for r in found) == [("http_basic", "alice:wonder")] * 2


def test_exchanges_go_on_in_the_next_trigger(spark, tmp_path):
    """A challenge in one file and its response in the next are a pair, which later triggers don't report again."""
    back = {"sport": 445, "dport": 50000, "src": SERVER, "dst": CLIENT}
    files = [stream(challenge(), **back), stream(response(), dport=445), stream(b"nothing of interest here", dport=9000, sport=50001)]
    (tmp_path / "in").mkdir()
    for n, records in enumerate(files):
        (tmp_path / f"in/eth0-{n}.pcap").write_bytes(pcap(records))
        losses = live.Losses()
        spark.streams.addListener(losses)
        query = live.live(spark, str(tmp_path / "in"), str(tmp_path / "out"), Settings(material_policy="raw"), files_per_trigger=1, available_now=True)
        query.awaitTermination(240)
        assert query.exception() is None
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(losses)
    found = spark.read.parquet(str(tmp_path / "out/findings")).where("detector = 'ntlm_challenge_response_correlation'").collect()
    assert [r["username"] for r in found] == ["eve"]
    verdict = live.live_verdict(spark, str(tmp_path / "out"), losses, query.id).first()
    assert verdict["verdict"] == "complete" and losses.timing(query.id)["longest"] > 0


def test_counters_of_a_stream(spark):
    from collections import namedtuple

    chunks = spark.createDataFrame([("gapped", {"tcp_forced_gap_bytes": 5}), ("gapped", {"tcp_forced_gap_bytes": 2}), ("complete", {}), ("midstream", None)], "completeness string, counters map<string,long>")
    chunks = chunks.selectExpr("*", "false as is_datagram", "0L as retransmitted", "0L as conflicts")
    parts = spark.createDataFrame([], detect_stream.PART)
    assert {r["name"]: r["value"] for r in detect_stream.stream_counters(chunks, parts).where("value > 0").collect()} == {"tcp_forced_gap_bytes": 7, "tcp_gapped_chunks": 2, "tcp_midstream_chunks": 1}
    operator = namedtuple("operator", "numRowsDroppedByWatermark")
    progress = namedtuple("progress", "id batchId stateOperators observedMetrics batchDuration")
    event = namedtuple("event", "progress")
    losses = live.Losses()
    for late in (4, 3):  # batch 0 twice, as after a failure
        losses.onQueryProgress(event(progress("q", 0, [operator(late)], {"skipped": {"fragment_incomplete": 1, "undecoded": 0}}, 30)))
    losses.onQueryProgress(event(progress("q", 1, [operator(2)], {}, 50)))
    losses.onQueryProgress(event(progress("other", 0, [operator(9)], {}, 9)))
    assert {r["name"]: r["value"] for r in losses.counters(spark, "q").collect()} == {"late_rows": 5, "undecoded_frames": 0, "packets_truncated": 0, **dict.fromkeys(live.FRAGMENT_LOSSES, 0), "fragment_incomplete": 1}
    assert losses.timing("q") == {"batches": 2, "total": 80, "longest": 50}


def test_exchanges_are_open_for_a_time(spark):
    def rows(*given):
        named = [dict(zip(("observed_timestamp_ns", "detector", "stop"), g)) | {"session_id": "s", "flow_id": "f", "epoch": 0, "direction": 0, "part": "record", "start": 0} for g in given]
        return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in detect_stream.PART.split(", ")) for r in named], detect_stream.PART)

    parts = rows((1_000_000_000, "ntlm_type2_challenge", 8), (5_000_000_000, "postgres_method", 9), (6_000_000_000, "redis_auth", 10))
    assert [r["detector"] for r in live.open_exchanges(parts, 3).collect()] == ["postgres_method"]
    assert live.open_exchanges(parts, 5).count() == 2 and live.open_exchanges(rows(), 5).count() == 0
    both = live.with_open_exchanges(parts, rows((5_000_000_000, "postgres_method", 9), (4_000_000_000, "postgres_method", 7)))
    assert sorted(r["stop"] for r in both.collect()) == [7, 8, 9, 10]


def test_open_exchanges_are_bounded_and_what_goes_is_counted(spark):
    """Of many challenges of one connection the latest stay; those that go without a response are counted."""
    names = [c.split()[0] for c in detect_stream.PART.split(", ")]
    from pyspark.sql import functions as F

    every = spark.range(100_000).select(F.lit("s").alias("session_id"), F.lit("f").alias("flow_id"), F.lit(0).cast("long").alias("epoch"), F.lit(1).alias("direction"), F.lit("record").alias("part"), F.lit("ntlm_type2_challenge").alias("detector"), "id")
    every = every.select("*", (F.lit(10**9) + F.col("id")).alias("observed_timestamp_ns"), F.col("id").alias("start"), (F.col("id") + 8).alias("stop"))
    parts = spark.createDataFrame([], detect_stream.PART).unionByName(every.drop("id"), allowMissingColumns=True).select(*names)
    kept = live.open_exchanges(parts, 300)
    assert sorted(r["start"] for r in kept.collect()) == list(range(100_000 - 64, 100_000))
    assert live.open_exchanges(parts, 300, per_flow=10**6, total=100).count() == 100
    assert [(r["name"], r["value"]) for r in live.given_up(parts, kept).collect()] == [("coverage_ntlm_unmatched_at_eviction", 100_000 - 64)]
    answer = every.where("id = 5").withColumns({"detector": F.lit("ntlm_type3_response"), "direction": F.lit(0)})
    both = parts.unionByName(answer.drop("id"), allowMissingColumns=True).select(*names)
    assert live.given_up(both, live.open_exchanges(both, 300)).first()["value"] == 0
