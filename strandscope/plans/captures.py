"""Registered queries that run the engine itself on packets made of the tables' rows, and the SQL of what it must find.

Packets are built from the protocols' layouts: each row of a table becomes a
datagram, a stream or an exchange, sent in pieces, out of order and repeated.
Then the same code as in ``replay`` decodes, joins, reassembles and detects.
"""

from __future__ import annotations

import base64
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect_stream, packets
from ..sources import capture
from .catalog import query, table

def scratch(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder; a local session without one gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
    return f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/strandscope-{uuid.uuid4().hex}"


_SERVER = bytes([10, 255, 0, 20])


def _client(k: int) -> bytes:
    return bytes([10, k >> 16 & 127, k >> 8 & 255, k & 255])


def _ipv4(k: int, back: bool, protocol: int, payload: bytes, *, ident: int = 1, offset: int = 0, more: bool = False) -> bytes:
    ends = (_SERVER + _client(k)) if back else (_client(k) + _SERVER)
    return bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), ident, offset // 8 | (0x2000 if more else 0), 64, protocol, 0) + ends + payload


def _tcp(k: int, back: bool, port: int, seq: int, payload: bytes, flags: int = 0x18, ack: int = 0) -> bytes:
    own = 1024 + k % 60_000
    a, b = (port, own) if back else (own, port)
    return _ipv4(k, back, 6, struct.pack(">HHIIBBHHH", a, b, seq & 0xFFFFFFFF, ack, 0x50, flags, 8192, 0, 0) + payload)


def _udp(k: int, port: int, payload: bytes) -> bytes:
    return struct.pack(">HHHH", 1024 + k % 60_000, port, 8 + len(payload), 0) + payload


def _stream(k: int, back: bool, port: int, data: bytes, *, seq: int = 0xFFFFFF00) -> list[bytes]:
    """A connection's opening and its bytes in two segments, the later one first and sent twice; numbers wrap in longer ones."""
    cut = len(data) // 2
    parts = [_tcp(k, back, port, seq + 1 + cut, data[cut:]), _tcp(k, back, port, seq + 1, data[:cut])]
    return [_tcp(k, back, port, seq, b"", 2 if not back else 18), *parts, parts[0]]


def _captured(rows: DataFrame, frames_of: Callable[..., list[bytes]]) -> DataFrame:
    """Packets (capture's schema) of each row's frames, or of (link type, frame, wire length); a row (key first) is a session."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = [c.split()[0] for c in capture.SCHEMA.split(", ")], []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                for n, made in enumerate(frames_of(*row)):
                    link, raw, wire = made if isinstance(made, tuple) else (1, made, len(made))
                    out.append((str(row[0]), n + 1, 1_000_000 * (n + 1), "made", link, len(raw), wire, raw, None))
                if len(out) >= 2_048:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    # a table of few bytes is read by few tasks, however many packets its rows become
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, rows.columns[0]).mapInPandas(build, capture.SCHEMA)


@query("""SELECT c_custkey, 40 + octet_length(encode(c_name)) AS ip_bytes, concat('10.', (c_custkey >> 16) & 127, '.', (c_custkey >> 8) & 255, '.', c_custkey & 255) AS src,
    CAST(1024 + c_custkey % 60000 AS INTEGER) AS sport, 8080 AS dport, CAST(c_custkey * 7 AS BIGINT) AS tcp_seq, md5(c_name) AS payload_md5 FROM customer""")
def decoded_segments(spark, sf_dir):
    """Ethernet, IPv4 and TCP headers of a frame for each customer."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), "c_name")
    frames_of = lambda k, name: [_tcp(int(k), False, 8080, int(k) * 7, name.encode())]
    found = packets.decode_segments(packets.decode_datagrams(_captured(rows, frames_of)))
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), (40 + F.length("payload")).cast("long").alias("ip_bytes"), "src", "sport", "dport", "tcp_seq", F.md5("payload").alias("payload_md5"))


@query("""SELECT c_custkey, CAST(octet_length(encode(c_name || '|' || c_name || '|' || c_name)) AS INTEGER) AS bytes, md5(c_name || '|' || c_name || '|' || c_name) AS payload_md5,
    3 AS packets FROM customer WHERE c_custkey % 10 <> 3""")
def joined_fragments(spark, sf_dir):
    """Datagrams of which the fragments came in another order; every tenth customer's lacks one and isn't there."""

    def frames_of(k: int, name: str) -> list[bytes]:
        whole = _udp(int(k), 9999, f"{name}|{name}|{name}".encode())
        cut = [_ipv4(int(k), False, 17, whole[a:b], ident=int(k) & 0xFFFF, offset=a, more=b < len(whole)) for a, b in ((0, 16), (16, 32), (32, len(whole)))]
        return [cut[2], cut[0]] if k % 10 == 3 else [cut[2], cut[0], cut[1]]

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), "c_name")
    found = packets.decode_segments(packets.defragment(packets.decode_datagrams(_captured(rows, frames_of)))).where("error is null")
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), F.length("payload").alias("bytes"), F.md5("payload").alias("payload_md5"), F.size("source_packet_ids").alias("packets"))


_LINES = "string_agg(l_partkey || ':' || l_suppkey || ';', '' ORDER BY l_linenumber, l_partkey, l_suppkey)"


@query(f"""SELECT l_orderkey, md5({_LINES}) AS stream_md5, CAST(octet_length(encode({_LINES})) AS BIGINT) AS bytes,
    CAST(octet_length(encode({_LINES})) - octet_length(encode({_LINES})) // 2 AS BIGINT) AS retransmitted FROM lineitem GROUP BY l_orderkey""")
def reassembled_streams(spark, sf_dir):
    """Every order's lines as a TCP stream, whose halves came in the wrong order, the second one twice, and whose numbers wrap."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), F.concat(x["l_suppkey"].cast("string"), F.lit(";")))), "")
    frames_of = lambda k, data: _stream(int(k), False, 8080, data.encode(), seq=0xFFFFFFF0)
    chunks = packets.reassemble(packets.decode_segments(packets.decode_datagrams(_captured(lines.select("k", text.alias("text")), frames_of))))
    return chunks.where("completeness = 'complete' and stream_offset = 0").select(F.col("session_id").cast("long").alias("l_orderkey"), F.md5("data").alias("stream_md5"), F.length("data").cast("long").alias("bytes"), "retransmitted")


# --- log-ins -----------------------------------------------------------------


def _ber(tag: int, body: bytes) -> bytes:
    return bytes([tag, len(body)]) + body


def _tds(user: str, secret: str) -> bytes:
    hidden = bytes((c >> 4 | (c & 15) << 4) ^ 0xA5 for c in secret.encode("utf-16le"))
    body = bytes(40) + struct.pack("<HHHH", 48, len(user), 48 + 2 * len(user), len(secret)) + user.encode("utf-16le") + hidden
    message = lambda kind, held: struct.pack(">BBHHBB", kind, 1, 8 + len(held), 0, 1, 0) + held
    return message(0x12, bytes(6)) + message(0x10, body)


def _ntlm_answer(user: str) -> bytes:
    parts, body = [], b""
    for value in (bytes(24), bytes(16) + b"\1\1\0\0" + bytes(40), b"", user.encode("utf-16le"), b"", b""):
        parts.append(struct.pack("<HHI", len(value), len(value), 64 + len(body)))
        body += value
    return b"NTLMSSP\0" + struct.pack("<I", 3) + b"".join(parts) + struct.pack("<I", 1) + body


def _login(k: int) -> list[bytes]:
    """A log-in by one of twelve protocols, as the customer's number says."""
    k = int(k)
    user, secret = f"u{k}", f"p{k}"
    encoded = lambda text: base64.b64encode(text.encode())
    form = f"username={user}&password={secret}".encode()
    digest = f'username="{user}", realm="r", nonce="n", uri="sip:h", response="{k:032x}"'
    streams = {
        0: (80, b"GET /x HTTP/1.1\r\nHost: h\r\nAuthorization: Basic " + encoded(f"{user}:{secret}") + b"\r\n\r\n"),
        1: (80, b"POST /in HTTP/1.1\r\nContent-Type: application/x-www-form-urlencoded\r\nContent-Length: %d\r\n\r\n" % len(form) + form),
        2: (21, f"USER {user}\r\nPASS {secret}\r\n".encode()),
        3: (6379, f"*3\r\n$4\r\nAUTH\r\n${len(user)}\r\n{user}\r\n${len(secret)}\r\n{secret}\r\n".encode()),
        4: (389, _ber(0x30, _ber(2, b"\1") + _ber(0x60, _ber(2, b"\3") + _ber(4, user.encode()) + _ber(0x80, secret.encode())))),
        5: (25, b"EHLO x\r\nAUTH PLAIN " + encoded(f"\0{user}\0{secret}") + b"\r\n"),
        6: (143, f"a1 LOGIN {user} {secret}\r\n".encode()),
        8: (1433, _tds(user, secret)),
        10: (80, f"GET /x HTTP/1.1\r\nHost: h\r\nAuthorization: Bearer t.{k}\r\n\r\n".encode()),
    }
    kind = k % 12
    if kind in streams:
        port, data = streams[kind]
        return _stream(k, False, port, data)
    if kind == 7:
        value = secret.encode() + b"\0"
        client = b"\0\0\0\x08\0\3\0\0" + b"p" + struct.pack(">I", 4 + len(value)) + value
        return [*_stream(k, True, 5432, b"R\0\0\0\x08\0\0\0\3" + b"R\0\0\0\x08\0\0\0\0"), *_stream(k, False, 5432, client)]
    if kind == 9:  # challenge, answer, and what the server says after it
        challenge = b"NTLMSSP\0" + struct.pack("<I", 2) + bytes(12) + struct.pack(">Q", k) + bytes(16)
        return [_tcp(k, True, 8443, 99, b"", 18), _tcp(k, True, 8443, 100, challenge), *_stream(k, False, 8443, _ntlm_answer(user)), _tcp(k, True, 8443, 100 + len(challenge), b"\1\2\3")]
    return [_ipv4(k, False, 17, _udp(k, 5060, f"REGISTER sip:h SIP/2.0\r\nAuthorization: Digest {digest}\r\n\r\n".encode()))]


_KINDS = (
    (0, "http_basic", "user_name", "user_name || ':' || secret"),
    (1, "sensitive_field", "user_name", "secret"),
    (2, "ftp_user_pass", "user_name", "user_name"),
    (2, "ftp_user_pass", "user_name", "secret"),
    (3, "redis_auth", "user_name", "secret"),
    (4, "ldap_simple_bind", "user_name", "secret"),
    (5, "smtp_auth_plain", "user_name", "secret"),
    (6, "imap_login", "user_name", "secret"),
    (7, "postgres_cleartext_password", "''", "secret"),
    (8, "mssql_tds_login7", "user_name", "secret"),
    (9, "raw_ntlmssp", "''", "printf('%016x', c_custkey)"),
    (9, "raw_ntlmssp", "user_name", "repeat('0', 32) || '01010000' || repeat('0', 80)"),
    (9, "ntlm_challenge_response_correlation", "user_name", "repeat('0', 32) || '01010000' || repeat('0', 80)"),
    (10, "http_bearer", "''", "'t.' || c_custkey"),
    (11, "sip_digest", "user_name", """'username="' || user_name || '", realm="r", nonce="n", uri="sip:h", response="' || printf('%032x', c_custkey) || '"'"""),
)


@query(
    "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'u' || c_custkey AS user_name, 'p' || c_custkey AS secret FROM customer) "
    + " UNION ALL ".join(f"SELECT c_custkey, '{detector}' AS detector, {user} AS username, md5({material}) AS material_md5, 1 AS whole FROM c WHERE c_custkey % 12 = {kind}" for kind, detector, user, material in _KINDS)
)
def login_findings(spark, sf_dir):
    """All findings in a log-in of each customer, and whether all packets that they came in are known."""
    folder = scratch(spark)

    def held(df: DataFrame, name: str) -> DataFrame:
        # as in a run with a scratch folder; one plan of all would have the packets' part a dozen times, with its tasks
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"))
    chunks = held(packets.reassemble(packets.decode_segments(packets.defragment(packets.decode_datagrams(_captured(rows, _login))))), "chunks")
    parts = held(detect_stream.parse_chunks(chunks), "parts")
    found = detect_stream.with_provenance(held(detect_stream.detect_streams(chunks, parts=parts), "found"), chunks)
    return found.select(F.col("session_id").cast("long").alias("c_custkey"), "detector", F.coalesce("username", F.lit("")).alias("username"), F.md5("material").alias("material_md5"), F.col("packet_ids_complete").cast("int").alias("whole"))
