"""Findings in reassembled streams and datagrams.

Framing and binary parsing run in Python over Arrow batches, one chunk at a
time; what they leave as text goes through the text detectors as columns, and
everything that relates findings to each other (roles, companions, pairing,
provenance, order) is joins and windows.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fields as roles
from ..functions import http1, wire
from . import correlate, detect_text, emit, intervals

STREAM = ["session_id", "flow_id", "epoch", "direction"]
_KEY = "session_id string, flow_id string, epoch long, direction int, is_datagram boolean, completeness string, observed_timestamp_ns long"
PART = _KEY + ", part string, message long, base long, cut boolean, text string, ends boolean, name string, encoded string, source string, start long, stop long, detector string, fields map<string,string>, counter string, value long"

# What each parsed record is reported as.
KINDS = {
    "ldap_simple_bind": ("credential", "ldap", "ldap_simple_bind_credentials", "confirmed"),
    "snmp_community": ("credential", "snmp", "snmp_community", "confirmed"),
    "mssql_tds_login7": ("credential", "mssql", "mssql_login7_credentials", "confirmed"),
    "kerberos_as_req_etype23": ("credential", "kerberos", "kerberos_as_req_etype23", "confirmed"),
    "redis_auth": ("credential", "redis", "redis_auth", "confirmed"),
    "postgres_password": ("authentication", "postgresql", "postgres_password_message", "medium"),
    "ntlm_type2_challenge": ("authentication", "ntlm", "ntlm_type2_challenge", "confirmed"),
    "ntlm_type3_response": ("authentication", "ntlm", "ntlm_type3_response", "confirmed"),
    "smtp_auth_plain": ("credential", "smtp", "smtp_auth_plain_credentials", "confirmed"),
    "smtp_auth_login": ("credential", "smtp", "smtp_auth_login_credentials", "confirmed"),
    "imap_login": ("credential", "imap", "imap_login_credentials", "confirmed"),
    "imap_auth_plain": ("credential", "imap", "imap_auth_plain_credentials", "confirmed"),
    "imap_auth_login": ("credential", "imap", "imap_auth_login_credentials", "confirmed"),
    "irc_registration": ("identity", "irc", "", "medium"),
    "telnet_like_login": ("credential", "plaintext_terminal", "telnet_like_login_field", "medium"),
    "http_file_signature": ("file_signature", "http", "file_signature", "high"),
    "http_text_login_field": ("credential", "http", "http_text_login_field", "medium"),
}
HEADER_DETECTORS = ("http_basic", "http_bearer", "http_digest", "http_cookie", "sip_digest")
CARD_DETECTORS = ("luhn_payment_card",)
#: Every line that a line protocol reports has one of these words; on mail ports, lines of NTLM have none.
LINE_WORDS = re.compile(rb"(?i)user|pass|nick|log[io]n|auth")
MAIL_PORTS = {25, 110, 143, 587}
SIP_PORT = 5060
#: Records that belong to exchanges which later bytes may go on.
EXCHANGED = ("ntlm_type2_challenge", "ntlm_type3_response", "postgres_method")


def may_have_lines(data: bytes, ports: set[int]) -> bool:
    """Whether line protocols have to be looked for at all: a superset test, cheaper than splitting into lines."""
    return bool(ports & MAIL_PORTS) or LINE_WORDS.search(data) is not None


def _guarded(name: str, parse: Callable[[], Iterable], counters: Counter) -> Iterator:
    """What a parser gives until it fails: one that fails on hostile bytes is counted and doesn't end the others."""
    try:
        yield from parse()
    except Exception:  # noqa: BLE001
        counters[f"parser_error:{name}"] += 1


def _parts_of(chunk, max_body: int) -> Iterator[dict]:
    """Rows of PART for one chunk: text to be searched, fields, parsed records, counters."""
    data, counters = bytes(chunk.data), Counter()
    base, ends, cut = int(chunk.stream_offset), bool(chunk.is_datagram), bool(getattr(chunk, "cut", False))
    ports = {int(p) for p in (chunk.sport, chunk.dport) if p == p and p is not None}

    def record(r: wire.Record) -> dict:
        return {"part": "record", "base": base, "start": base + r.start, "stop": base + r.stop, "detector": r.kind, "fields": {k: str(v) for k, v in r.values.items()}}

    messages = list(_guarded("http_framing", lambda: http1.frame(data, counters, max_body=max_body), counters))
    masked = bytearray(data)
    for t in _guarded("http_transfers", lambda: http1.transfers(messages, counters), counters):
        yield record(wire.Record("http_file_signature", t["start"], t["stop"], {"material": t["kind"], "declared": t["declared"], "mismatch": str(t["mismatch"]).lower(), "file_name": t["file_name"] or "", "partial": str(not t["complete"]).lower()}))
        masked[t["body_start"] : t["body_end"]] = bytes(t["body_end"] - t["body_start"])
    for n, m in enumerate(messages):
        yield {"part": "header", "message": n, "base": base + m.start, "text": wire.latin(data[m.start : m.header_end]), "ends": True}
        shown = bytes(masked[m.start : m.header_end if m.encoded else m.end])
        yield {"part": "message", "message": n, "base": base + m.start, "text": wire.latin(shown), "ends": m.complete}
        found: list[tuple[str, http1.Field, int, int]] = []
        if b"?" in m.target:
            at = m.target_start + m.target.index(b"?") + 1
            found += [("query", f, at + f.start, at + f.stop) for f in http1.form_fields(m.target[m.target.index(b"?") + 1 :])]
        form = m.content_type == "application/x-www-form-urlencoded"
        is_json = m.content_type == "application/json" or m.content_type.endswith("+json")
        if m.encoded:
            counters["http_body_unsupported_content_encoding"] += 1
        elif form:
            found += [("form", f, *m.wire(f.start, f.stop)) for f in http1.form_fields(m.body, complete=m.complete)]
        elif is_json and m.complete:
            try:
                found += [("json", f, *m.wire(f.start, f.stop)) for f in http1.json_fields(m.body)]
            except (ValueError, RecursionError):
                counters["http_body_invalid_json"] += 1
        elif m.body and not is_json:
            counters["http_body_unsupported_content_type"] += 1
            if m.is_request or m.content_type.startswith("text/"):
                for start, stop, text in wire.lines(m.body, m.complete):
                    for r in wire.line_protocols(text, set(), True):
                        if r.kind == "telnet_like_login" and r.values["field"].lower() != "telnet":
                            a, b = m.wire(start, stop)
                            identity = r.values["field"].lower() in ("login", "logon", "username", "user")
                            yield record(wire.Record("http_text_login_field", a, b, r.values | {"protocol": "http", "confidence": "medium", "category": "identity" if identity else "credential"}))
        if len(found) >= http1.MAX_FIELDS:
            counters["http_body_field_limit"] += 1
        for source, f, start, stop in found:
            yield {"part": "field", "message": n, "base": base, "text": f.value, "encoded": f.encoded, "name": f.name, "source": source, "start": base + start, "stop": base + stop}
    if not messages:
        if data.startswith(http1.PREFACE_2):
            counters["http_transfer_http2_unsupported"] += 1
        yield {"part": "raw_sip" if SIP_PORT in ports else "raw", "base": base, "cut": cut, "text": wire.latin(data), "ends": ends}
        if may_have_lines(data, ports):
            for r in _guarded("line_protocols", lambda: wire.line_protocols(data, ports, ends), counters):
                yield record(r)
    binary: dict[str, Iterator[wire.Record]] = {"ntlm_raw": wire.ntlm_raw(bytes(masked)), "ntlm_http": wire.ntlm_http(data), "ldap": wire.ldap(data), "kerberos": wire.kerberos(data)}
    if ends:
        binary["snmp"] = wire.snmp(data)
    if data[:1] in (wire.TDS_LOGIN, wire.TDS_PRELOGIN):
        binary["tds"] = wire.tds(data)
    if chunk.dport == 6379:
        binary["redis"] = wire.redis(data, counters)
    if chunk.dport == 5432:
        binary["postgres_client"] = wire.postgres_client(data, counters)
    if chunk.sport == 5432:
        binary["postgres_server"] = wire.postgres_server(data)
    for name, parser in binary.items():
        for r in _guarded(name, lambda parser=parser: parser, counters):
            yield record(r)
    for name, value in counters.items():
        yield {"part": "counter", "counter": name, "value": value}


def parse_chunks(chunks: DataFrame, *, max_body: int = 131_072) -> DataFrame:
    names = [p.split()[0] for p in PART.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk in batch.itertuples(index=False):
                key = {"session_id": chunk.session_id, "flow_id": chunk.flow_id, "epoch": chunk.epoch, "direction": chunk.direction, "is_datagram": chunk.is_datagram, "completeness": chunk.completeness, "observed_timestamp_ns": chunk.last_timestamp_ns}
                starts, times = [s["start"] for s in chunk.spans], [s["time"] for s in chunk.spans]
                for part in _parts_of(chunk, max_body):
                    if part.get("stop") is not None and starts:  # seen when its last byte came
                        part["observed_timestamp_ns"] = times[max(0, bisect.bisect_right(starts, part["stop"] - 1) - 1)]
                    rows.append(key | part)
            out = pd.DataFrame([[row.get(c) for c in names] for row in rows], columns=names)
            yield out.astype({c: "Int64" for c in ("epoch", "direction", "observed_timestamp_ns", "message", "base", "start", "stop", "value")} | {"ends": "boolean", "cut": "boolean", "is_datagram": "boolean"})

    needed = [*STREAM, "sport", "dport", "stream_offset", "cut", "data", "last_timestamp_ns", "completeness", "is_datagram", "spans"]
    return chunks.select(*needed).mapInPandas(parse, PART)


_OUT = [*STREAM, "is_datagram", "completeness", "observed_timestamp_ns", "detector", "category", "protocol", "material_type", "confidence", "start", "stop", "material", "username"]


def _text_findings(parts: DataFrame, kinds: dict[str, tuple[str, ...]], extra: Iterable[str]) -> DataFrame:
    """Findings of the detectors named in ``kinds`` in the parts of their kinds, by one scan."""
    wanted = [d for d in detect_text.text_detectors(extra) if d.name in kinds]
    # on SIP's port, a digest is SIP's without its version in the text
    at_port = [replace(d, gate="", literals=()) for d in wanted if d.name == "sip_digest"]
    on = lambda d: ("raw_sip",) if d in at_port else tuple(k for k in (*kinds[d.name], "raw_sip") if k != "raw_sip" or (d.name not in ("sip_digest", "http_digest") and "raw" in kinds[d.name]))
    rows = parts.where(F.col("part").isin("raw_sip", *sorted({k for held in kinds.values() for k in held}))).select(*STREAM, "is_datagram", "completeness", "observed_timestamp_ns", "part", "base", "ends", "cut", "text")
    found = detect_text.detect(rows, "text", detectors=[*wanted, *at_port], ends="ends", cut=F.coalesce("cut", F.lit(False)), where=lambda d: F.col("part").isin(*on(d)))
    return found.select(*_OUT[: _OUT.index("start")], (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("stop")).alias("stop"), "material", "username")


def _field_findings(parts: DataFrame, extra: Iterable[str]) -> DataFrame:
    """Sensitive fields of framed messages with the only identity of the same query or body."""
    rows = parts.where("part = 'field'").withColumn("role", roles.field_role(F.col("name"), extra)).where("role is not null")
    group = [*STREAM, "message", "source"]
    companions = correlate.sole_companion(rows.where("role <> 'sensitive'"), group, "role", "text", "username", "username_weak")
    found = rows.where("role = 'sensitive'").join(companions, group, "left")
    return found.select(*STREAM, "is_datagram", "completeness", "observed_timestamp_ns", *(F.lit(v).alias(c) for c, v in (("detector", "sensitive_field"), ("category", "credential"), ("protocol", "http"), ("material_type", "sensitive_field"), ("confidence", "high"))), "start", "stop", F.col("text").alias("material"), F.col("companion").alias("username"))


def _record_findings(parts: DataFrame) -> DataFrame:
    rows = parts.where("part = 'record' and detector <> 'postgres_method'")
    value = lambda name: F.col("fields")[name]
    lead = F.regexp_extract("detector", "^(.*)_user_pass$", 1)

    def column(i: int):
        out = F.lit(None).cast("string")
        for kind, values in KINDS.items():
            out = F.when(F.col("detector") == kind, values[i]).otherwise(out)
        return out

    return rows.select(
        *STREAM, "is_datagram", "completeness", "observed_timestamp_ns",
        F.coalesce(value("detector"), "detector").alias("detector"),
        F.coalesce(value("category"), F.when(lead != "", "credential"), column(0)).alias("category"),
        F.coalesce(value("protocol"), F.when(lead != "", lead), column(1)).alias("protocol"),
        F.coalesce(value("material_type"), column(2)).alias("material_type"),
        F.coalesce(value("confidence"), column(3)).alias("confidence"),
        "start", "stop", value("material").alias("material"), value("username").alias("username"),
    )


def _exchanges(parts: DataFrame) -> DataFrame:
    """Challenges and responses on the side of the peer that answers."""
    rows = parts.where("part = 'record' and detector in ('ntlm_type2_challenge', 'ntlm_type3_response')")
    rows = rows.withColumns({"is_challenge": F.col("detector") == "ntlm_type2_challenge", "session": F.coalesce(F.col("fields")["session"], F.lit(""))})
    # the peer's direction, so that both stand on one side of the exchange
    rows = rows.withColumn("side", F.when(F.col("is_challenge"), 1 - F.col("direction")).otherwise(F.col("direction")))
    rows = rows.select(*STREAM, "is_datagram", "completeness", "observed_timestamp_ns", "start", "stop", "side", "session", "is_challenge", F.col("fields")["material"].alias("material"), F.col("fields")["username"].alias("username"), F.col("fields")["version"].alias("version"))
    return rows


def ambiguous_sessions(rows: DataFrame) -> DataFrame:
    """From when on session 0 of a side of a connection is ambiguous: another challenge came before the last was answered."""
    zero = F.col("session").rlike("^0+$")
    order = ["observed_timestamp_ns", F.desc("is_challenge"), "start"]
    by_order = W.partitionBy("session_id", "flow_id", "epoch", "side").orderBy(*order)
    zeros = rows.where(zero).withColumn("open", F.lag(F.when(F.col("is_challenge"), F.col("material"))).over(by_order))
    return zeros.where(F.col("is_challenge") & (F.col("open") != F.col("material"))).groupBy("session_id", "flow_id", "epoch", "side").agg(F.min("observed_timestamp_ns").alias("mixed_at"))


def pair_ntlm(parts: DataFrame) -> DataFrame:
    """Responses with the challenge of the other direction that came last before them in the same connection and session.

    Records stand in the order of the packets that completed them, whatever
    their directions sent later. A challenge answers one response. In session
    0, which several log-ins may share, a second challenge before the first is
    answered makes the rest of the connection ambiguous: nothing pairs there.
    """
    rows = _exchanges(parts)
    order = ["observed_timestamp_ns", F.desc("is_challenge"), "start"]
    paired = correlate.pair_once(rows.withColumn("challenge", F.col("material")), ["session_id", "flow_id", "epoch", "side", "session"], order, F.col("is_challenge"), ~F.col("is_challenge"), ["challenge"], prefix="its_")
    zero = F.col("session").rlike("^0+$")
    mixed = ambiguous_sessions(rows)
    paired = paired.join(mixed, ["session_id", "flow_id", "epoch", "side"], "left").where(~zero | F.col("mixed_at").isNull() | (F.col("observed_timestamp_ns") < F.col("mixed_at")))
    found = paired.where(F.col("its_challenge").isNotNull() & F.col("version").isin("netntlmv1", "netntlmv2"))
    return found.select(*STREAM, "is_datagram", "completeness", "observed_timestamp_ns", F.lit("ntlm_challenge_response_correlation").alias("detector"), F.lit("credential").alias("category"), F.lit("ntlm").alias("protocol"), F.col("version").alias("material_type"), F.when(zero, "high").otherwise("confirmed").alias("confidence"), "start", "stop", "material", "username")


def qualify_postgres(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """Password messages by the method that the server asked for last before them: in the clear, they are confirmed credentials.

    Method 0 says that the log-in is over and asks for nothing, so it counts
    only where no method was asked for. Where the capture has no method before
    a password, as its directions may be captured apart, the connection's last
    one counts.
    """
    methods = parts.where("part = 'record' and detector = 'postgres_method'").select("session_id", "flow_id", "epoch", F.col("observed_timestamp_ns").alias("at"), "start", F.col("fields")["method"].alias("method"))
    latest = methods.groupBy("session_id", "flow_id", "epoch").agg(F.max_by("method", F.struct(F.col("method") != "0", "at", "start")).alias("method"))
    passwords = findings.where("material_type = 'postgres_password_message'")
    both = passwords.withColumn("asked", F.lit(None).cast("string")).unionByName(
        methods.where("method <> '0'").select("session_id", "flow_id", "epoch", F.col("at").alias("observed_timestamp_ns"), "start", F.col("method").alias("asked")), allowMissingColumns=True
    )
    order = ["observed_timestamp_ns", F.col("asked").isNull(), "start"]
    before = correlate.carry_forward(both, ["session_id", "flow_id", "epoch"], order, F.col("asked").isNotNull(), "asked", "before").where("asked is null").drop("asked")
    joined = before.join(latest, ["session_id", "flow_id", "epoch"], "left").withColumn("method", F.coalesce("before", "method")).drop("before")
    clear = F.col("method") == "3"
    known = joined.where(F.coalesce(F.col("method").isin("3"), F.lit(True))).withColumns({"detector": F.when(clear, "postgres_cleartext_password").otherwise("postgres_password_message"), "category": F.when(clear, "credential").otherwise("authentication"), "confidence": F.when(clear, "confirmed").otherwise("medium")})
    return findings.where("material_type <> 'postgres_password_message'").unionByName(known.drop("method"))


def with_provenance(findings: DataFrame, chunks: DataFrame, *, most: int = 8_192) -> DataFrame:
    """Add packet_ids (those whose bytes a finding has, in order) and packet_ids_complete."""
    spans = chunks.select(*STREAM, "stream_offset", F.explode("spans").alias("s")).select(*STREAM, F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.packet_ids").alias("ids"))
    ranged = findings.select(*STREAM, "start", "stop").distinct()
    met = intervals.range_join(ranged, spans, STREAM, width=8_192)
    covered = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    ids = met.groupBy(*STREAM, "start", "stop").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r_ids")))).alias("ids"), F.sum(covered).alias("covered"))
    out = findings.join(ids, [*STREAM, "start", "stop"], "left")
    whole = (F.col("covered") >= F.col("stop") - F.col("start")) & (F.size("ids") <= most)
    return out.withColumns({"packet_ids": F.slice(F.coalesce("ids", F.array().cast("array<long>")), 1, most), "packet_ids_complete": F.coalesce(whole, F.lit(False))}).drop("ids", "covered")


def detect_streams(chunks: DataFrame, *, extra_names: Iterable[str] = (), generic_secret_scan: bool = True, credit_card_scan: bool = True, parts: DataFrame | None = None) -> DataFrame:
    """Findings of all detectors, each position once, numbered within flow, epoch and kind of material.

    ``parts`` may be given as a written table of ``parse_chunks``; else chunks
    are parsed once for each group of detectors.
    """
    extra = tuple(extra_names)
    parts = parse_chunks(chunks) if parts is None else parts
    kinds = {d: ("header", "raw") for d in HEADER_DETECTORS} | {"sensitive_field": ("raw",)}
    if generic_secret_scan:
        kinds |= {d.name: ("message", "raw") for d in detect_text.text_detectors() if d.name not in kinds and d.name not in CARD_DETECTORS}
    if credit_card_scan:
        kinds |= dict.fromkeys(CARD_DETECTORS, ("message", "raw"))
    found = [_text_findings(parts, kinds, extra), _field_findings(parts, extra), _record_findings(parts), pair_ntlm(parts)]
    every = qualify_postgres(reduce(DataFrame.unionByName, found), parts)
    scope = [*STREAM, "detector", "material_type"]
    once = emit.exactly_once(every, scope, ["start", "stop"], "stop")
    numbered = emit.attempt_ordinal(once, ["session_id", "flow_id", "epoch", "material_type"], ["observed_timestamp_ns", "direction", "start", "stop", "detector"])
    return numbered.withColumn("finding_id", emit.finding_id(*STREAM, "detector", "start", "stop"))


def stream_counters(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """name and value of what framing, parsing and reassembly had to give up or met."""
    framing = parts.where("part = 'counter'").select(F.col("counter").alias("name"), "value")
    if "counters" in chunks.columns:
        framing = framing.unionByName(chunks.where("counters is not null").select(F.explode("counters").alias("name", "value")))
    tcp = chunks.where("not is_datagram").select(
        F.explode(
            F.map_from_arrays(
                F.array(*map(F.lit, ("retransmitted_bytes", "tcp_conflicting_overlaps", "tcp_gapped_chunks", "tcp_midstream_chunks"))),
                F.array("retransmitted", "conflicts", (F.col("completeness") == "gapped").cast("long"), (F.col("completeness") == "midstream").cast("long")),
            )
        ).alias("name", "value")
    )
    return framing.unionByName(tcp).groupBy("name").agg(F.sum("value").alias("value"))


def coverage(parts: DataFrame) -> DataFrame:
    """name and value of what parsers recognised and couldn't relate: responses of an unknown format or in an ambiguous session, passwords without a method."""
    records = parts.where("part = 'record'")
    responses = records.where("detector = 'ntlm_type3_response'")
    odd = responses.where(F.col("fields")["version"] == "unsupported")
    methods = records.where("detector = 'postgres_method'").select("session_id", "flow_id", "epoch")
    unasked = records.where("detector = 'postgres_password'").join(methods, ["session_id", "flow_id", "epoch"], "left_anti")
    zero = F.coalesce(F.col("fields")["session"], F.lit("")).rlike("^0+$")
    shared = ambiguous_sessions(_exchanges(parts)).select("session_id", "flow_id", "epoch", "side", "mixed_at")
    mixed = responses.where(zero).withColumn("side", F.col("direction")).join(shared, ["session_id", "flow_id", "epoch", "side"]).where("observed_timestamp_ns >= mixed_at")
    named = (("coverage_ntlm_response_format_unsupported", odd), ("coverage_postgres_auth_method_unknown", unasked), ("coverage_ntlm_zero_session_ambiguous", mixed))
    return reduce(DataFrame.unionByName, (rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value") for name, rows in named))


def unmatched_responses(parts: DataFrame) -> DataFrame:
    """One counter: responses without a challenge."""
    responses = parts.where("part = 'record' and detector = 'ntlm_type3_response'").select(*STREAM, "start", "stop")
    left = correlate.unmatched(responses, pair_ntlm(parts), [*STREAM, "start", "stop"])
    return left.agg(F.count("*").alias("value")).select(F.lit("coverage_ntlm_unmatched_responses").alias("name"), "value")
