"""More registered queries that run the engine on packets made of the tables' rows: link types, files, gaps, protocols, losses, and the stream."""

from __future__ import annotations

import base64
import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import detect_stream, health, packets
from ..operators.flow import PacketFilter
from ..sources import capture
from ..streaming import live
from .captures import _KINDS, _ber, _captured, _ipv4, _login, _ntlm_answer, _stream, _tcp, _udp, scratch
from .catalog import query, table
from .replay import replay_packets


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), "c_name")


# --- links -------------------------------------------------------------------


def _v6(k: int, payload: bytes, extensions: bytes = b"", kind: int = 17) -> bytes:
    address = bytes([0x20, 1, 0x0D, 0xB8]) + bytes(8)
    return struct.pack(">IHBB", 6 << 28, len(extensions) + len(payload), kind, 64) + address + struct.pack(">I", k) + address + b"\0\0\0\1" + extensions + payload


def _linked(k: int, name: str) -> list[tuple[int, bytes, int]]:
    """A datagram in a frame of one of eight kinds of link and network header."""
    k = int(k)
    data = _udp(k, 9999, name.encode())
    v4 = _ipv4(k, False, 17, data)[14:]
    hop = bytes([60, 0]) + bytes(6) + bytes([17, 1]) + bytes(14)  # hop-by-hop, then destination options of 16 bytes
    auth = bytes([17, 4]) + bytes(22)
    raw = {
        0: (1, bytes(12) + struct.pack(">HHHHH", 0x88A8, 5, 0x8100, k % 4096, 0x0800) + v4),
        1: (113, bytes(14) + b"\x08\x00" + v4),
        2: (276, b"\x08\x00" + bytes(18) + v4),
        3: (0, b"\x02\0\0\0" + v4),
        4: (12, v4),
        5: (12, _v6(k, data, hop, 0)),
        6: (1, bytes(12) + b"\x86\xdd" + _v6(k, data, auth, 51)),
        7: (229, _v6(k, data)),
    }[k % 8]
    return [(*raw, len(raw[1]))]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 8 < 5 THEN concat('10.', (c_custkey >> 16) & 127, '.', (c_custkey >> 8) & 255, '.', c_custkey & 255)
        WHEN c_custkey >> 16 = 0 THEN '2001:db8::' || printf('%x', c_custkey) ELSE '2001:db8::' || printf('%x:%x', c_custkey >> 16, c_custkey & 65535) END AS src,
    CAST(1024 + c_custkey % 60000 AS INTEGER) AS sport, CASE WHEN c_custkey % 8 = 0 THEN '5,' || (c_custkey % 4096) ELSE '' END AS vlans, md5(c_name) AS payload_md5 FROM customer""")
def decoded_links(spark, sf_dir):
    """Frames with VLAN tags, of four other link types, and of IPv6 with extension headers."""
    found = packets.decode_segments(packets.decode_datagrams(_captured(_customers(spark, sf_dir), _linked))).where("error is null")
    vlans = F.array_join(F.transform("vlan_ids", lambda v: v.cast("string")), ",")
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), "src", "sport", vlans.alias("vlans"), F.md5("payload").alias("payload_md5"))


@query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(1024 + c_custkey % 60000 AS INTEGER) AS sport, c_custkey % 8 AS kind FROM customer)
    SELECT c_custkey, sport FROM c WHERE kind < 5 AND c_custkey & 255 BETWEEN 64 AND 127 AND c_custkey >> 8 = 0 AND sport NOT IN (1100, 1101) OR c_custkey = 5""")
def filtered_packets(spark, sf_dir):
    """Packets of a net of IPv4 or an address of IPv6, but for two ports."""
    wanted = PacketFilter(nets=frozenset({"10.0.0.64/26", "2001:db8::5/128"}), protocols=frozenset({17}), without=PacketFilter(ports=frozenset({1100, 1101})))
    found = packets.decode_segments(packets.decode_datagrams(_captured(_customers(spark, sf_dir), _linked))).where(wanted.column())
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), "sport")


# --- files -------------------------------------------------------------------


def _file(k: int, name: str) -> bytes:
    """A capture file of two packets: classic in both byte orders, PCAPNG with two interfaces and their statistics, or a classic one that breaks off."""
    one, two = name.encode(), name.encode() * 2
    if k % 4 == 2:
        block = lambda kind, body: struct.pack(">II", kind, 12 + len(body) + -len(body) % 4) + body + bytes(-len(body) % 4) + struct.pack(">I", 12 + len(body) + -len(body) % 4)
        packet = lambda number, raw: block(6, struct.pack(">IIIII", number, 0, k, len(raw), len(raw)) + raw)
        interface = block(1, struct.pack(">HHI", 1, 0, 65_535))
        return block(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1)) + interface + packet(0, one) + interface + packet(1, two) + block(5, struct.pack(">III", 1, 0, 0) + struct.pack(">HHQHHQHH", 4, 8, k, 5, 8, k % 7, 0, 0))
    order, magic, unit = (">", 0xA1B23C4D, 1) if k % 4 == 1 else ("<", 0xA1B2C3D4, 1000)
    record = lambda raw: struct.pack(order + "IIII", 1, k * 1000 // unit % 1_000_000, len(raw), len(raw)) + raw
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65_535, 1) + record(one) + record(two)
    return out[:-1] if k % 4 == 3 else out


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 2 END AS packets, CASE WHEN c_custkey % 4 = 3 THEN 'truncated_record' END AS error,
    CASE c_custkey % 4 WHEN 2 THEN c_custkey * 1000 WHEN 1 THEN 1000000000 + c_custkey * 1000 % 1000000 ELSE 1000000000 + c_custkey % 1000000 * 1000 END AS first_ns,
    CASE WHEN c_custkey % 4 = 2 THEN 'pcap:made#1' ELSE 'pcap:made' END AS last_interface, md5(CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE c_name || c_name || c_name END) AS bytes_md5,
    CASE WHEN c_custkey % 4 = 2 THEN c_custkey END AS received, CASE WHEN c_custkey % 4 = 2 THEN c_custkey % 7 END AS dropped FROM customer""")
def capture_files(spark, sf_dir):
    """Each customer's capture file: its packets, why it breaks off, and what its statistics say."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, name in zip(batch["c_custkey"], batch["c_name"], strict=True):
                content = _file(int(k), name)
                rows = list(capture.rows_of(io.BytesIO(content), str(k), "made"))
                good = [r for r in rows if r[8] is None]
                told = capture.given(io.BytesIO(content)).get(1, {})
                out.append((k, len(good), next((r[8] for r in rows if r[8]), None), good[0][2], good[-1][3], b"".join(r[7] for r in good), told.get(capture.RECEIVED), told.get(capture.DROPPED)))
            yield pd.DataFrame(out, columns=["c_custkey", "packets", "error", "first_ns", "last_interface", "bytes", "received", "dropped"]).astype({"received": "Int64", "dropped": "Int64"})

    found = _customers(spark, sf_dir).mapInPandas(read, "c_custkey long, packets int, error string, first_ns long, last_interface string, bytes binary, received long, dropped long")
    return found.withColumn("bytes_md5", F.md5("bytes")).drop("bytes")


# --- streams with faults -----------------------------------------------------


def _faulty(k: int, name: str) -> list[bytes]:
    """A stream that lacks a segment, one whose beginning wasn't captured, and one in which bytes come again and differ; a keep-alive in each."""
    k, data = int(k), f"{name}|{name}|{name}".encode()
    send = lambda a, b, raw=None: _tcp(k, False, 8080, 1_000 + a, data[a:b] if raw is None else raw)
    opening, peer = _tcp(k, False, 8080, 999, b"", 2), _tcp(k, True, 8080, 1, b"", 16, ack=1_016)
    alive = _tcp(k, False, 8080, 1_015, b"?", 16)  # acknowledged already
    if k % 3 == 0:
        return [opening, send(0, 16), peer, alive, send(32, len(data))]
    if k % 3 == 1:
        return [send(0, 16), peer, alive, send(16, len(data))]
    return [opening, send(0, 16), peer, alive, send(8, 24, b"0" * 16), send(24, len(data))]


@query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name || '|' || c_name || '|' || c_name AS data FROM customer)
    SELECT c_custkey, 0 AS stream_offset, md5(substr(data, 1, 16)) AS data_md5, 'complete' AS completeness, 0 AS retransmitted, 0 AS conflicts FROM c WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 32, md5(substr(data, 33)), 'gapped', 0, 0 FROM c WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 0, md5(data), 'midstream', 0, 0 FROM c WHERE c_custkey % 3 = 1
    UNION ALL SELECT c_custkey, 0, md5(substr(data, 1, 16) || '00000000' || substr(data, 25)), 'complete', 8, 1 FROM c WHERE c_custkey % 3 = 2""")
def faulty_streams(spark, sf_dir):
    """Chunks of streams with gaps, without a beginning and with conflicting repetitions."""
    chunks = packets.reassemble(packets.decode_segments(packets.decode_datagrams(_captured(_customers(spark, sf_dir), _faulty))))
    return chunks.select(F.col("session_id").cast("long").alias("c_custkey"), "stream_offset", F.md5("data").alias("data_md5"), "completeness", "retransmitted", "conflicts")


@query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer), use AS (SELECT unnest(range(3)) AS n)
    SELECT c_custkey, n, md5(c_name || n || c_name || c_name) AS payload_md5, 2 AS packets FROM c, use WHERE NOT (n = 1 AND c_custkey % 5 = 2)""")
def fragment_ids_again(spark, sf_dir):
    """Three datagrams of one fragment id within a second; of every fifth customer's, the second has fragments that contradict each other."""

    def frames_of(k: int, name: str) -> list[bytes]:
        k, out = int(k), []
        for n in range(3):
            whole = _udp(k, 9999, f"{name}{n}{name}{name}".encode())
            cut = [_ipv4(k, False, 17, whole[a:b], ident=77, offset=a, more=b < len(whole)) for a, b in ((0, 16), (16, len(whole)))]
            clash = [_ipv4(k, False, 17, bytes(16), ident=77, offset=0, more=True)] if n == 1 and k % 5 == 2 else []
            out += [cut[0], *clash] if clash else cut[:: 1 if n % 2 else -1]
        return out

    found = packets.decode_segments(packets.defragment(packets.decode_datagrams(_captured(_customers(spark, sf_dir), frames_of)))).where("error is null")
    n = F.substring(F.decode("payload", "ISO-8859-1"), 19, 1).cast("long")
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), n.alias("n"), F.md5("payload").alias("payload_md5"), F.size("source_packet_ids").alias("packets"))


# --- protocols ---------------------------------------------------------------


def _letters(k: int, width: int) -> str:
    return "".join("ABCDEFGHIJ"[int(c)] for c in str(k)).rjust(width, "Z")


def _kerberos(k: int) -> bytes:
    """An AS-REQ with an encrypted timestamp of type 23."""
    text = lambda tag, value: _ber(tag, value.encode())
    cipher = _ber(0xA2, _ber(4, k.to_bytes(52, "big")))
    sealed = _ber(0x30, _ber(0xA0, _ber(2, b"\x17")) + cipher)
    given = _ber(0x30, _ber(0xA1, _ber(2, b"\2")) + _ber(0xA2, _ber(4, sealed)))
    name = _ber(0xA1, _ber(0x30, _ber(0xA0, _ber(2, b"\1")) + _ber(0xA1, _ber(0x30, text(0x1B, f"u{k}")))))
    asked = _ber(0xA4, _ber(0x30, name + _ber(0xA2, text(0x1B, "R"))))
    body = _ber(0x30, _ber(0xA1, _ber(2, b"\5")) + _ber(0xA2, _ber(2, b"\x0a")) + _ber(0xA3, _ber(0x30, given)) + asked)
    return bytes([0x6A, 0x81, len(body)]) + body if len(body) > 127 else _ber(0x6A, body)


def _spoken(k: int) -> list[bytes]:
    """What one of 32 kinds of clients sends, as the customer's number says."""
    k = int(k)
    user, secret, word = f"u{k}", f"p{k}", _letters(k, 16)
    b64 = lambda text: base64.b64encode(text.encode() if isinstance(text, str) else text)
    url64 = lambda text: b64(text).translate(bytes.maketrans(b"+/", b"-_")).rstrip(b"=").decode()
    post = lambda kind, body, more="": f"POST /x HTTP/1.1\r\nContent-Type: {kind}\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + (body if isinstance(body, bytes) else body.encode())
    said = lambda text: (80, post("text/plain", f"it is {text} .\n"))
    digest = f'username="{user}", realm="r", nonce="n", uri="/x", response="{k:032x}"'
    challenge = b"NTLMSSP\0" + struct.pack("<I", 2) + bytes(12) + struct.pack(">Q", k) + bytes(16)
    answer = _ntlm_answer(user)
    form = f"username={user}&password={secret}".encode()
    streams = {
        0: (80, f"GET / HTTP/1.1\r\nHost: h\r\nCookie: sid=s{k}\r\n\r\n".encode()),
        2: said(url64('{"alg":"none"}') + "." + url64(f'{{"sub":"{user}"}}') + "."),
        3: said("AKIA" + word),
        4: said("AIza" + _letters(k, 35)),
        5: said("ghp_" + _letters(k, 36)),
        6: said("xoxb-" + word),
        7: said("sk_live_" + word),
        8: said(f"-----BEGIN PRIVATE KEY-----\n{word}\n-----END PRIVATE KEY-----"),
        9: said("4111 1111 1111 1111" if k % 64 < 32 else "5500-0055-5555-5559"),
        10: (80, post("application/json", f'{{"user":"{user}","password":"{secret}"}}')),
        11: (80, b"POST /x HTTP/1.1\r\nContent-Type: application/x-www-form-urlencoded\r\nTransfer-Encoding: chunked\r\n\r\n%x\r\n" % (len(form) - 1) + form[:-1] + b"\r\n1\r\n" + form[-1:] + b"\r\n0\r\n\r\n"),
        12: (80, f"GET /x?token=t{k}&y=1 HTTP/1.1\r\nHost: h\r\n\r\n".encode()),
        13: (80, post("text/plain", f"username: {user}\r\npassword: {secret}\r\n")),
        16: (6667, f"NICK n{k}\r\nUSER {user} 0 * :x\r\n".encode()),
        17: (23, f"login: {user}\r\npassword: {secret}\r\n".encode()),
        18: (587, b"AUTH LOGIN\r\n" + b64(user) + b"\r\n" + b64(secret) + b"\r\n"),
        19: (25, b"AUTH PLAIN\r\n" + b64(f"\0{user}\0{secret}") + b"\r\n"),
        20: (143, b"a1 AUTHENTICATE PLAIN\r\n" + b64(f"\0{user}\0{secret}") + b"\r\n"),
        21: (143, b"a1 AUTHENTICATE LOGIN\r\n" + b64(user) + b"\r\n" + b64(secret) + b"\r\n"),
        22: (110, f"USER {user}\r\nPASS {secret}\r\n".encode()),
        23: (80, f"GET /x HTTP/1.1\r\nAuthorization: Digest {digest}\r\n\r\n".encode()),
        26: (80, post("image/png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I", k))),
        27: (80, post('multipart/form-data; boundary="b--1"', b'--b--1\r\nContent-Disposition: form-data; name="f"; filename="a.zip"\r\nContent-Type: application/zip\r\n\r\nPK\5\6' + bytes(18) + b"\r\n--b--1--\r\n")),
        28: (9000, f"x?token=t{k}&z\n".encode()),
        29: (9000, f'x {{"client_secret": "{word}"}}\n'.encode()),
        30: (6379, f'AUTH "p {k}"\r\n'.encode()),
    }
    kind = k % 32
    if kind in streams:
        port, data = streams[kind]
        return _stream(k, False, port, data)
    if kind == 1:
        return _stream(k, True, 80, f"HTTP/1.1 200 OK\r\nSet-Cookie: theme=t{k}; Path=/\r\nContent-Length: 0\r\n\r\n".encode())
    if kind == 14:
        body = _ber(2, b"\1") + _ber(4, f"c{k}".encode()) + _ber(0xA0, _ber(2, b"\1") + _ber(2, b"\0") + _ber(2, b"\0") + _ber(0x30, b""))
        return [_ipv4(k, False, 17, _udp(k, 161, _ber(0x30, body)))]
    if kind == 15:
        return [_ipv4(k, False, 17, _udp(k, 88, _kerberos(k)))]
    if kind == 31:
        return [_ipv4(k, False, 17, _udp(k, 5060, f"Authorization: Digest {digest}\r\n\r\n".encode()))]
    port, asks, tells = {
        24: (80, b"HTTP/1.1 401 No\r\nWWW-Authenticate: NTLM " + b64(challenge) + b"\r\nContent-Length: 0\r\n\r\n", b"GET /x HTTP/1.1\r\nAuthorization: NTLM " + b64(answer) + b"\r\n\r\n"),
        25: (25, b"334 " + b64(challenge) + b"\r\n", b64(answer) + b"\r\n"),
    }[kind]
    return [_tcp(k, True, port, 99, b"", 18), _tcp(k, True, port, 100, asks), *_stream(k, False, port, tells), _tcp(k, True, port, 100 + len(asks), b"\r\n")]


_WORD, _ANSWER = "lpad(translate(CAST(k AS VARCHAR), '0123456789', 'ABCDEFGHIJ'), {}, 'Z')", "repeat('0', 32) || '01010000' || repeat('0', 80)"
_DIGEST = """'username="' || u || '", realm="r", nonce="n", uri="/x", response="' || printf('%032x', k) || '"'"""
_SPOKEN = (
    (0, "http_cookie", "''", "'sid=s' || k"),
    (1, "http_cookie", "''", "'theme=t' || k || '; Path=/'"),
    (2, "jwt", "''", """rtrim(base64(encode('{"alg":"none"}')), '=') || '.' || rtrim(translate(base64(encode('{"sub":"' || u || '"}')), '+/', '-_'), '=') || '.'"""),
    (3, "aws_access_key", "''", "'AKIA' || " + _WORD.format(16)),
    (4, "google_api_key", "''", "'AIza' || " + _WORD.format(35)),
    (5, "github_token", "''", "'ghp_' || " + _WORD.format(36)),
    (6, "slack_token", "''", "'xoxb-' || " + _WORD.format(16)),
    (7, "stripe_secret", "''", "'sk_live_' || " + _WORD.format(16)),
    (8, "pem_private_key", "''", "'-----BEGIN PRIVATE KEY-----' || chr(10) || " + _WORD.format(16) + " || chr(10) || '-----END PRIVATE KEY-----'"),
    (9, "luhn_payment_card", "''", "CASE WHEN k % 64 < 32 THEN '4111111111111111' ELSE '5500005555555559' END"),
    (10, "sensitive_field", "u", "p"),
    (11, "sensitive_field", "u", "p"),
    (12, "sensitive_field", "''", "'t' || k"),
    (13, "http_text_login_field", "''", "u"),
    (13, "http_text_login_field", "''", "p"),
    (14, "snmp_community", "''", "'c' || k"),
    (15, "kerberos_as_req_etype23", "u", "printf('%0104x', k)"),
    (16, "irc_registration", "''", "'n' || k"),
    (16, "irc_registration", "''", "u || ' 0 * :x'"),
    (17, "telnet_like_login", "''", "u"),
    (17, "telnet_like_login", "''", "p"),
    (18, "smtp_auth_login", "u", "p"),
    (19, "smtp_auth_plain", "u", "p"),
    (20, "imap_auth_plain", "u", "p"),
    (21, "imap_auth_login", "u", "p"),
    (22, "pop3_user_pass", "u", "u"),
    (22, "pop3_user_pass", "u", "p"),
    (23, "http_digest", "u", _DIGEST),
    (24, "http_ntlm", "''", "printf('%016x', k)"),
    (24, "http_ntlm", "u", _ANSWER),
    (24, "ntlm_challenge_response_correlation", "u", _ANSWER),
    (25, "mail_ntlm", "''", "printf('%016x', k)"),
    (25, "mail_ntlm", "u", _ANSWER),
    (25, "ntlm_challenge_response_correlation", "u", _ANSWER),
    (26, "http_file_signature", "''", "'png'"),
    (27, "http_file_signature", "''", "'zip'"),
    (28, "sensitive_field", "''", "'t' || k"),
    (29, "generic_secret_assignment", "''", _WORD.format(16)),
    (30, "redis_auth", "''", "'p ' || k"),
    (31, "sip_digest", "u", _DIGEST),
)


@query(
    "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, 'u' || c_custkey AS u, 'p' || c_custkey AS p FROM customer) "
    + " UNION ALL ".join(f"SELECT k AS c_custkey, '{detector}' AS detector, {user} AS username, md5({material}) AS material_md5 FROM c WHERE k % 32 = {kind}" for kind, detector, user, material in _SPOKEN)
)
def protocol_findings(spark, sf_dir):
    """All findings in what 32 kinds of clients send: headers, tokens, keys, bodies, line and binary protocols, multi-step log-ins."""
    rows = _customers(spark, sf_dir).select("c_custkey")
    chunks = packets.reassemble(packets.decode_segments(packets.defragment(packets.decode_datagrams(_captured(rows, _spoken)))))
    # parsed once, as in a run with a scratch folder
    folder = scratch(spark)
    detect_stream.parse_chunks(chunks).write.parquet(f"{folder}/parts")
    found = detect_stream.detect_streams(chunks, parts=spark.read.schema(detect_stream.PART).parquet(f"{folder}/parts"))
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), "detector", F.coalesce("username", F.lit("")).alias("username"), F.md5("material").alias("material_md5"))


# --- losses ------------------------------------------------------------------


def _lossy(k: int) -> list:
    """Traffic of which something can't be used: what, says the customer's number."""
    k = int(k)
    request = lambda head, body=b"": _stream(k, False, 80, b"POST /x HTTP/1.1\r\n" + head + b"\r\n\r\n" + body)
    part = lambda a, b, raw, more, ident=5: _ipv4(k, False, 17, raw[a:b], ident=ident, offset=a, more=more)
    whole = _udp(k, 9999, bytes(40))
    kind = k % 24
    heads = {
        4: (b"Content-Length: 1\r\nContent-Length: 2", b""),
        5: (b"Transfer-Encoding: gzip", b""),
        6: (b"Content-Length: x", b""),
        7: (b"Host: h", b"a=1"),
        8: (b"Transfer-Encoding: chunked", b"z\r\n"),
        9: (b"Content-Length: 0", b"what\r\n"),
        11: (b"Content-Type: application/json\r\nContent-Length: 1", b"{"),
        12: (b"Content-Encoding: gzip\r\nContent-Length: 1", b"x"),
        16: (b"Content-Type: image/png\r\nTransfer-Encoding: chunked", b"1\r\nx\r\n0\r\n\r\n"),
        17: (b"Content-Type: multipart/form-data; boundary=b\r\nContent-Length: 1", b"x"),
        18: (b"Content-Disposition: attachment; filename=a\r\nContent-Type: image/png\r\nContent-Length: 1", b"x"),
        19: (b"Content-Type: application/x-www-form-urlencoded\r\nContent-Length: %d" % 1_280, b"&a=1&" * 256),
        20: (b"Transfer-Encoding: chunked", b"5\r\nab"),
    }
    if kind in heads:
        return request(*heads[kind])
    if kind == 0:
        return [bytes(12) + b"\x08\x00" + b"\x45\0\0\0\0"]
    if kind == 1:
        return [part(0, 16, whole, True)]
    if kind == 2:
        return [part(0, 16, whole, True), part(0, 16, b"\xff" * 16, True)]
    if kind == 3:
        cut = _tcp(k, False, 8080, 1, b"abcdefgh")
        return [(1, cut[:-4], len(cut))]
    if kind == 10:
        return _stream(k, False, 80, b"POST /x HTTP/1.1\r\nHost: h\r\n")
    if kind == 13:
        return _stream(k, False, 6379, b"*x\r\n")
    if kind == 14:
        return _stream(k, False, 8443, _ntlm_answer("u"))
    if kind == 15:
        value = b"secret\0"
        return _stream(k, False, 5432, b"\0\0\0\x08\0\3\0\0" + b"p" + struct.pack(">I", 4 + len(value)) + value)
    if kind == 21:
        return [bytes(12) + b"\x08\x00" + b"\x45\0\0\x18" + bytes(5) + b"\x06" + bytes(10) + bytes(4)]
    if kind == 22:
        return _stream(k, False, 80, b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n")
    return [_tcp(k, False, 8080, 9, b"", 2), _tcp(k, False, 8080, 12, b"late")]


_LOSSES = {
    "decode_short_ipv4": (0,), "decode_fragment_incomplete": (1,), "decode_fragment_conflicting_overlap": (2,), "packets_truncated": (3,), "http_framing_ambiguous": (4,), "http_framing_unsupported_transfer_encoding": (5,),
    "http_framing_invalid_length": (6,), "http_framing_missing_body_length": (7,), "http_framing_invalid_chunk": (8,), "http_framing_invalid_request": (9,), "http_framing_tail_lost": (10, 20), "http_body_invalid_json": (11,),
    "http_body_unsupported_content_encoding": (12,), "coverage_cleartext_frame_boundary_lost": (13,), "coverage_ntlm_unmatched_responses": (14,), "coverage_postgres_auth_method_unknown": (15,), "http_transfer_chunked_unsupported": (16,),
    "http_transfer_multipart_prefix_unresolved": (17,), "http_transfer_declared_file_unverified": (18,), "http_body_field_limit": (19,), "decode_short_tcp": (21,), "http_transfer_http2_unsupported": (22,), "tcp_gapped_chunks": (23,),
    "tcp_midstream_chunks": (3,), "http_transfer_unbounded_body": (7,), "http_transfer_content_encoding_unsupported": (12,), "http_body_unsupported_content_type": (7, 16, 17, 18),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS value FROM customer WHERE c_custkey % 24 IN ({', '.join(map(str, kinds))}) HAVING count(*) > 0" for name, kinds in _LOSSES.items()))
def loss_counters(spark, sf_dir):
    """What a run counts as lost: frames, fragments, gaps, framing, bodies, transfers, and messages that couldn't be related."""
    run = replay_packets(_captured(_customers(spark, sf_dir).select("c_custkey"), _lossy), scratch=scratch(spark))
    return run.counters.where(~F.col("name").isin(*health.BENIGN))


# --- the stream --------------------------------------------------------------


@query(
    "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'u' || c_custkey AS user_name, 'p' || c_custkey AS secret FROM customer) "
    + " UNION ALL ".join(f"SELECT c_custkey, '{detector}' AS detector, {user} AS username, md5({material}) AS material_md5, 1 AS whole FROM c WHERE c_custkey % 12 = {kind}" for kind, detector, user, material in _KINDS)
)
def live_findings(spark, sf_dir):
    """As login_findings, by the streaming query: each log-in's packets come in two triggers, so connections and exchanges go on in the second."""
    folder = scratch(spark)
    made = _captured(_customers(spark, sf_dir).select("c_custkey"), _login)
    for n, half in enumerate((F.col("packet_id") <= 3, F.col("packet_id") > 3)):
        made.where(half).write.mode("append").parquet(f"{folder}/in/{n}")
    # the first trigger takes the first half's files, which are the oldest, the next ones the other's
    files = max(1, len(spark.read.schema(made.schema).parquet(f"{folder}/in/0").inputFiles()))
    rows = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    # a state store for each core is enough for these tables, whatever the session's exchanges are
    partitions = "spark.sql.shuffle.partitions"
    before = spark.conf.get(partitions)
    spark.conf.set(partitions, str(min(int(before), max(4, spark.sparkContext.defaultParallelism))))
    try:
        running = live.analyse(rows, f"{folder}/out", Settings(material_policy="raw"), available_now=True)
        running.awaitTermination()
    finally:
        spark.conf.set(partitions, before)
    if running.exception():
        raise running.exception()
    found = spark.read.parquet(f"{folder}/out/findings")
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), "detector", F.coalesce("username", F.lit("")).alias("username"), F.md5("material").alias("material_md5"), F.col("packet_ids_complete").cast("int").alias("whole"))
