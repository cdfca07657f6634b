"""What the fourth round's review found: flows that cost a state each, packets that are made over and over, and exchanges that a bound dropped."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from test_capture import BASIC, CLIENT, SERVER, challenge, pcap, response, stream, tcp
from test_findings_r03 import _same_as_sql
from test_streaming import fed

import __spark_entry__
from strandscope.config import Settings
from strandscope.functions import frames
from strandscope.operators import detect_stream
from strandscope.plans import exchanges
from strandscope.streaming import live


def _at(*records) -> bytes:
    """A capture file of frames at given seconds."""
    return pcap([]) + b"".join(struct.pack("<IIII", 1_700_000_000 + seconds, n, len(r), len(r)) + r for n, (seconds, r) in enumerate(records))


# --- F1 ----------------------------------------------------------------------


def _segments(flow_id, seconds, raw_frames):
    out = []
    for n, raw in enumerate(raw_frames):
        s = frames.segment(6, frames.datagram(raw, 1, len(raw)).payload)
        out.append(("s", flow_id, 6, 0, n, seconds * 10**9 + n, s.sport, s.dport, s.seq, 0, s.flags, s.payload, [n]))
    return pd.DataFrame(out, columns=["session_id", "flow_id", "protocol", "direction", "packet_id", "timestamp_ns", "sport", "dport", "tcp_seq", "tcp_ack", "tcp_flags", "payload", "source_packet_ids"])


def test_flows_that_share_a_state_go_on_and_end_apart():
    settings, kept = Settings(), {}
    run = lambda watermark, *batches: [(key[1], c["completeness"], c["data"]) for key, c in live.advance_flows(iter(batches), kept, watermark * 1000, settings)]
    early = [stream(b"abcd")[0], tcp(b"late", seq=1_010)]
    assert run(0, pd.concat([_segments("a", 1, early), _segments("b", 1, stream(BASIC, cuts=[9])[:2])])) == [("b", "complete", BASIC[:9])]
    # what a flow keeps is looked at when its own segments come or its own time is over
    held = kept["s", "a"]
    assert run(100, _segments("b", 250, stream(BASIC, cuts=[9])[2:])) == [("b", "complete", BASIC)] and kept["s", "a"] == held
    assert run(302, _segments("b", 400, [tcp(b"more", seq=1_000 + len(BASIC))])) == [("b", "complete", b"more"), ("a", "gapped", b"late"), ("a", live.OVER, b"")]
    assert list(kept) == [("s", "b")]
    assert run(701) == [("b", live.OVER, b"")] and not kept


def test_a_stream_has_no_more_states_than_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SHARDS", 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(_at(*((0, r) for n in range(40) for r in stream(BASIC, cuts=[20], sport=50_000 + n))))
    query = live.live(spark, str(tmp_path / "in"), str(tmp_path / "out"), Settings(), available_now=True)
    query.awaitTermination(240)
    assert query.exception() is None
    states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "applyInPandasWithState"]
    assert states and max(states) <= 3
    assert spark.read.parquet(str(tmp_path / "out/findings")).where("detector = 'http_basic'").count() == 40


def test_live_findings_make_packets_in_many_tasks_and_two_triggers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchanges, "scratch", lambda _: str(tmp_path / "scratch"))
    rows = spark.range(300).selectExpr("id AS c_custkey", "'x' AS c_name")
    got, want = _same_as_sql(spark, tmp_path / "tables", "live_findings", customer=rows)
    assert got == want and len(got) == 375
    files = lambda pattern: len(list((tmp_path / "scratch").glob(pattern)))
    assert files("in/0/*.parquet") >= spark.sparkContext.defaultParallelism
    sizes = [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "scratch/out/chunks").glob("batch=*"))]
    assert len([n for n in sizes if n]) == 2


# --- F2 ----------------------------------------------------------------------


def test_log_ins_are_parsed_once(spark, tmp_path):
    rows = spark.range(48).selectExpr("id AS c_custkey", "'x' AS c_name")
    got, want = _same_as_sql(spark, tmp_path, "login_findings", customer=rows)
    assert got == want and len(got) == 60
    plan = __spark_entry__.queries()["login_findings"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan


# --- F3 ----------------------------------------------------------------------


def _records(spark, n: int, epoch: int = 0, datagram: bool = False):
    names = [c.split()[0] for c in detect_stream.PART.split(", ")]
    known = {"session_id": "'s'", "flow_id": "'f'", "epoch": f"{epoch}L", "direction": "1", "is_datagram": str(datagram), "observed_timestamp_ns": "id * 60000000000", "part": "'record'", "detector": "'ntlm_type2_challenge'", "start": "id", "stop": "id + 8"}
    made = spark.range(n).selectExpr(*(f"{v} AS {c}" for c, v in known.items()))
    return spark.createDataFrame([], detect_stream.PART).unionByName(made, allowMissingColumns=True).select(*names)


def test_all_exchanges_of_connections_that_go_on_are_carried(spark):
    parts = _records(spark, 100_000).unionByName(_records(spark, 70, epoch=1)).unionByName(_records(spark, 5, epoch=9, datagram=True))
    over = lambda *rows: spark.createDataFrame(list(rows), "session_id string, flow_id string, epoch long")
    assert live.carried(parts, over(("s", "other", 7))).count() == 100_070
    assert live.carried(parts, over(("s", "f", 0), ("s", "f", 1))).groupBy("epoch").count().collect() == [(1, 70)]
    assert live.carried(parts, over(("s", "f", 2))).count() == 0


def test_only_connections_with_new_records_are_taken_up(spark):
    before = _records(spark, 3).unionByName(_records(spark, 2, epoch=1))
    again = _records(spark, 1)  # in bytes that are read again
    assert sorted((r["epoch"], r["start"]) for r in live.taken_up(again, before).collect()) == [(0, 1), (0, 2)]
    assert live.taken_up(again.withColumn("part", F.lit("raw")), before).count() == 0


def test_an_exchange_goes_on_behind_many_others_and_after_a_long_time(spark, tmp_path):
    """A method asked for before 70 other records, and a challenge answered after 500 seconds on a connection that never rested."""
    asked = b"R\0\0\0\x08\0\0\0\3" + b"R\0\0\0\x08\0\0\0\0" * 70
    told = b"\0\0\0\x08\0\3\0\0" + b"p" + struct.pack(">I", 11) + b"secret\0"
    server = {"src": SERVER, "dst": CLIENT}
    more = lambda text, at: tcp(text, seq=1_000 + len(challenge()) + at, sport=445, dport=50_000, **server)
    files = [
        _at(*((0, r) for r in [*stream(asked, sport=5432, dport=50_001, **server), *stream(challenge(), sport=445, dport=50_000, **server)])),
        _at(*((100, r) for r in stream(told, sport=50_001, dport=5432)), (200, more(b"\1\2\3", 0)), (350, more(b"\4\5\6", 3))),
        _at(*((500, r) for r in stream(response(), sport=50_000, dport=445))),
    ]
    found, verdict, _ = fed(spark, tmp_path, files)
    named = sorted((r["detector"], r["username"] or r["material"]) for r in found if r["detector"] != "raw_ntlmssp")
    assert named == [("ntlm_challenge_response_correlation", "eve"), ("postgres_cleartext_password", "secret")]
    assert len(found) == 4 and len({r["finding_id"] for r in found}) == 4 and verdict["verdict"] == "complete"
