"""Detectors for sensitive material in text, as column expressions.

They run on any frame with a text column: documents, or reassembled streams
decoded byte for byte (ISO-8859-1), where positions are byte offsets. A match
needs an observed end: text that is a datagram or a document ends where it
ends, a stream's end ends nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as roles
from ..functions import http1
from ..functions import text as T

FINDING = ("detector", "category", "protocol", "material_type", "confidence", "start", "stop", "material", "username")

# Names and schemes that decide what a finding is called.
SESSION_COOKIES = ("sid", "session", "sessionid", "sessiontoken", "jsessionid", "phpsessid", "aspsessionid", "aspnetsessionid", "connectsid", "authtoken", "accesstoken", "idtoken", "jwt", "token")
SCHEMES = ("basic", "bearer", "digest", "negotiate", "ntlm")

# What providers document as the form of their keys.
AWS_KEY = "(?<![A-Z0-9])(?:AKIA|ASIA|AIDA|AROA|AIPA|ANPA|ANVA|ASCA)[A-Z0-9]{16}(?![A-Z0-9])"
GOOGLE_KEY = "(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"
GITHUB_TOKEN = "(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{20,255})(?![A-Za-z0-9_])"
SLACK_TOKEN = "(?<![A-Za-z0-9-])xox[baprs]-[A-Za-z0-9-]{10,200}(?![A-Za-z0-9-])"
STRIPE_KEY = "(?<![A-Za-z0-9_])sk_(?:live|test)_[A-Za-z0-9]{16,}(?![A-Za-z0-9_])"

# The grammars of RFC 9112 (start lines), 9110 (credentials), 7519 (tokens of three base64url parts), 7468 (PEM)
# and ISO 7812 (13 to 19 digits). The bounds must be these, since a longer value is no finding.
LINE = "(?md)"  # ^ and $ at newlines only, as in byte patterns
START_LINE = LINE + rf"^(?:{http1.REQUEST_LINE}|{http1.STATUS_LINE})\r?\n"
AUTH = r"(?mid)^((?:Proxy-)?Authorization[ \t]*:[ \t]*"
TOKEN_PARTS = r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{3,2048})\.([A-Za-z0-9_-]{3,4096})\.([A-Za-z0-9_-]{0,2048})(?![A-Za-z0-9_.-])"
PEM = r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----[\s\S]{16,65536}?-----END \1-----"
CARD = r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])"
# A name of at most 64 characters with a value of 8 to 4,096, or a form field of at most 8,192, up to what ends it.
ASSIGNMENT = r"""(?i)((?:^|[\s{,;])["']?)([a-z][a-z0-9_.-]{1,63})(["']?\s*[:=]\s*["']?)([^\s"'&,;}\]]{8,4096})(?=[\s"'&,;}\]])"""
PAIR = r"(?i)((?:^|[?&;\s])([a-z][a-z0-9_.-]{0,63})=)([^&;\s]{0,8192})(?=[&;\s])"


@dataclass(frozen=True)
class Detector:
    """``pattern``'s ``material`` group is reported; groups in ``before`` are matched in front of it, from the match's start.

    ``accept`` filters on the match struct (start, stop, whole, g1, ...); the
    columns of the finding may depend on it too.
    """

    name: str
    category: str
    protocol: str
    material_type: str
    confidence: str
    pattern: str
    material: int = 0
    before: tuple[int, ...] = ()
    more: tuple[int, ...] = ()
    literals: tuple[str, ...] = ()  # a text without any of them has no match, which a scan of its bytes tells
    gate: str = ""  # what every text with a match has, by a pattern, which costs a hundred times as much
    unless: str = ""  # texts in which this occurs are another detector's
    accept: Callable[[Column], Column] | None = None
    columns: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    datagram_only: bool = False
    own_end: bool = False  # the pattern itself contains what ends the material

    @property
    def groups(self) -> tuple[int, ...]:
        return tuple(sorted({*self.before, *self.more, *([self.material] if self.material else [])}))


def _card(m: Column) -> Column:
    digits = F.regexp_replace(m["whole"], "[ -]", "")
    return (F.length(digits).between(13, 19)) & (F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) > 0) & T.luhn_valid(digits)


def _jwt_kind(m: Column) -> Column:
    header = T.json_object(T.base64_bytes(m["g1"]))
    payload = T.json_object(T.base64_bytes(m["g2"]))
    algorithm = F.try_element_at(header, F.lit("alg"))
    quoted = F.decode(T.base64_bytes(m["g1"]), "ISO-8859-1").rlike(r'"alg"\s*:\s*"')
    fine = header.isNotNull() & payload.isNotNull() & quoted & (F.length(algorithm) > 0)
    unsigned = F.lower(algorithm) == "none"
    return F.when(fine & unsigned & (m["g3"] == ""), "unsigned").when(fine & ~unsigned & (F.length(m["g3"]) >= 8) & T.base64_bytes(m["g3"]).isNotNull(), "signed")


def _credentials(m: Column) -> Column:
    return F.decode(T.base64_bytes(m["g2"]), "ISO-8859-1")


def _digest_needs(*names: str) -> Callable[[Column], Column]:
    """Whether a digest header has all of the parameters."""
    return lambda m: reduce(lambda a, b: a & b, (m["g2"].rlike(rf"(?i)(?:^|[\s,]){n}\s*=") for n in names))


def _cookie_session(m: Column) -> Column:
    names = F.transform(F.split(m["g2"], ";"), lambda p: F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.substring_index(p, "=", 1))), "^__(host|secure)-", ""), "[-_.]", ""))
    return F.exists(names, lambda n: n.isin(*SESSION_COOKIES) | n.endswith("sessiontoken"))


def _token(name: str, material_type: str, pattern: str, gate: str, literals: tuple[str, ...]) -> Detector:
    return Detector(name, "secret", "generic", material_type, "high", pattern, literals=literals, gate=gate)


def text_detectors(extra_names: Iterable[str] = ()) -> tuple[Detector, ...]:
    """The detectors of headers, tokens, keys, assignments, fields and cards."""
    names = sorted({n.lower() for n in (*roles.SENSITIVE_NAMES, *extra_names)})
    # what the two grammars of names and values need around a sensitive name: few texts have it, and only they are searched
    named = "(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + ")"
    assigned, paired = rf"""(?i)(?:^|[\s{{,;])["']?{named}["']?\s*[:=]""", rf"(?i)(?:^|[?&;\s]){named}="
    return (
        Detector("http_basic", "credential", "http", "http_basic_credentials", "confirmed", AUTH + r"Basic[ \t]+)([A-Za-z0-9+/=_-]{4,})[ \t]*\r?\n", 2, (1,), literals=(":",), gate="(?i)authorization", accept=lambda m: F.contains(_credentials(m), F.lit(":")), columns={"material": _credentials, "username": lambda m: F.substring_index(_credentials(m), ":", 1)}, own_end=True),
        Detector("http_bearer", "credential", "http", "bearer_token", "confirmed", AUTH + r"Bearer[ \t]+)([^\s,]{1,8192})[ \t]*\r?\n", 2, (1,), literals=(":",), gate="(?i)authorization", own_end=True),
        Detector("http_digest", "credential", "http", "http_digest_response", "confirmed", AUTH + r"Digest[ \t]+)([^\r\n]{8,8192})\r?\n", 2, (1,), literals=(":",), gate="(?i)authorization", unless="SIP/2\\.0", accept=_digest_needs("username", "realm", "nonce", "uri", "response"), columns={"username": lambda m: F.regexp_extract(m["g2"], r'(?i)(?:^|[\s,])username\s*=\s*"([^"]*)"', 1)}, own_end=True),
        Detector("sip_digest", "credential", "sip", "sip_digest_response", "confirmed", AUTH + r"Digest[ \t]+)([^\r\n]{8,8192})\r?\n", 2, (1,), literals=("SIP/2.0",), gate="SIP/2\\.0", accept=_digest_needs("username", "realm", "nonce", "uri", "response"), columns={"username": lambda m: F.regexp_extract(m["g2"], r'(?i)(?:^|[\s,])username\s*=\s*"([^"]*)"', 1)}, own_end=True),
        Detector("http_cookie", "cookie", "http", "cookie", "medium", r"(?mid)^((Cookie|Set-Cookie)[ \t]*:[ \t]*)([^\r\n]{1,16384})\r?\n", 3, (1,), (2,), literals=(":",), gate="(?i)cookie", columns={"category": lambda m: F.when(_cookie_session(F.struct(m["g3"].alias("g2"))), "session").otherwise("cookie"), "material_type": lambda m: F.when(F.lower(m["g2"]) == "set-cookie", "set_cookie").otherwise("cookie")}, own_end=True),
        Detector("jwt", "secret", "generic", "jwt", "high", TOKEN_PARTS, more=(1, 2, 3), literals=(".",), gate="(?i)eyJ", accept=lambda m: _jwt_kind(m).isNotNull(), columns={"confidence": lambda m: F.when(_jwt_kind(m) == "unsigned", "medium").otherwise("high")}),
        _token("aws_access_key", "cloud_access_key_id", AWS_KEY, "A[KSIRN][IPVDOC]A", ("AKIA", "ASIA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASCA")),
        _token("google_api_key", "cloud_api_key", GOOGLE_KEY, "AIza", ("AIza",)),
        _token("github_token", "source_control_token", GITHUB_TOKEN, "gh[pousr]_|github_pat_", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
        _token("slack_token", "chat_token", SLACK_TOKEN, "xox", ("xox",)),
        _token("stripe_secret", "payment_api_secret", STRIPE_KEY, "sk_", ("sk_",)),
        Detector("generic_secret_assignment", "secret", "generic", "named_secret", "medium", ASSIGNMENT, 4, (1, 2, 3), literals=("=", ":"), gate=assigned, accept=lambda m: F.lower(m["g2"]).isin(names) & ~((F.lower(m["g2"]) == "authorization") & F.lower(m["g4"]).isin(*SCHEMES)), own_end=True),
        Detector("sensitive_field", "credential", "generic", "sensitive_field", "medium", PAIR, 3, (1,), (2,), literals=("=",), gate=paired, accept=lambda m: F.lower(m["g2"]).isin(names), columns={"material": lambda m: T.url_decoded(m["g3"])}, own_end=True),
        Detector("pem_private_key", "secret", "generic", "private_key", "confirmed", PEM, literals=("PRIVATE KEY-----",), gate="-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", own_end=True),
        Detector("luhn_payment_card", "financial", "generic", "payment_card_candidate", "medium", CARD, gate="[0-9](?:[ -]?[0-9]){12}", accept=_card, columns={"material": lambda m: F.regexp_replace(m["whole"], "[ -]", "")}),
    )


def in_byte_range_header(text: Column, start: Column) -> Column:
    """Whether the line around a position is a Range or Content-Range header in bytes: digits there are offsets, not card numbers."""
    before = F.substring(text, F.greatest(start - 8191, F.lit(1)), F.least(start, F.lit(8191)))
    line = F.regexp_extract(before, r"(?s)([^\r\n]*)$", 1)
    return line.rlike(r"(?i)^range[ \t]*:[ \t]*bytes[ \t]*=[0-9, \t-]*$|^content-range[ \t]*:[ \t]*bytes[ \t]+[0-9/-]*$")


def _found(text: Column, d: Detector, ends: Column) -> Column:
    """array<struct<FINDING>> of one detector in a text."""
    # an implicit newline ends what a whole document or datagram leaves open
    subject = F.concat(text, F.when(ends, "\n").otherwise("")) if d.own_end else text
    matches = T.find_all(subject, d.pattern, d.groups)
    if not d.own_end:
        size = F.length(text)
        matches = F.filter(matches, lambda m: (m["stop"] < size) | ends)
    if d.accept:
        matches = F.filter(matches, d.accept)

    def finding(m: Column) -> Column:
        start = m["start"] + sum((F.length(m[f"g{g}"]) for g in d.before), F.lit(0))
        material = m[f"g{d.material}"] if d.material else m["whole"]
        values = {"match_start": m["start"], "detector": F.lit(d.name), "category": F.lit(d.category), "protocol": F.lit(d.protocol), "material_type": F.lit(d.material_type), "confidence": F.lit(d.confidence), "start": start, "stop": start + F.length(material), "material": material, "username": F.lit(None).cast("string")}
        values |= {name: make(m) for name, make in d.columns.items()}
        return F.struct(*(values[c].alias(c) for c in (*FINDING, "match_start")))

    return F.transform(matches, finding)


def _in_context(text: Column, d: Detector, ends: Column) -> Column:
    """As ``_found``, with what two detectors want to know of the whole text, which is looked at once."""
    if d.name == "sensitive_field":
        of_http = lambda http: replace(d, columns=d.columns | {"protocol": lambda m: F.when(http, "http").otherwise("generic"), "confidence": lambda m: F.when(http, "high").otherwise("medium")})
        return T.let(text.rlike(START_LINE), lambda http: _found(text, of_http(http), ends))
    if d.name == "luhn_payment_card":
        but_ranges = lambda ranged: replace(d, accept=lambda m: _card(m) & ~(ranged & in_byte_range_header(text, m["start"])))
        return T.let(text.rlike("(?mi)^(?:content-)?range[ \t]*:"), lambda ranged: _found(text, but_ranges(ranged), ends))
    return _found(text, d, ends)


_SHAPE = "array<struct<detector:string,category:string,protocol:string,material_type:string,confidence:string,start:int,stop:int,material:string,username:string,match_start:int>>"


#: Expressions by what they are built of. An expression names columns, so it serves any frame that has them.
_EXPRESSIONS: dict[tuple, Column] = {}


def _built(d: Detector, text: str, ends: str | None) -> Column:
    """A detector's expression on the column ``text``: thousands of calls to the JVM, made once for each detector of a process."""
    from pyspark import SparkContext

    key = id(SparkContext._gateway), d.name, d.pattern, d.gate, text, ends
    if key not in _EXPRESSIONS:
        _EXPRESSIONS[key] = _in_context(F.col(text), d, F.lit(True) if ends is None else F.col(ends)).cast(_SHAPE)
    return _EXPRESSIONS[key]


def detect(rows: DataFrame, text: str, *, detectors: Iterable[Detector] | None = None, ends: Column | str | None = None, where: Callable[[Detector], Column | None] = lambda d: None, cut: Column | None = None) -> DataFrame:
    """All columns of ``rows`` but the text, and FINDING, one row for each finding of each detector.

    One scan serves all detectors. ``ends`` is, or names, a column that says whether a text's end is an end
    for a match (default: yes), ``where`` on which rows a detector runs
    (default: all). ``sensitive_field`` is of protocol http with confidence high
    if the text has an HTTP start line. Card candidates in byte-range headers
    are left out. Where ``cut`` holds, the text begins in the middle of
    something: a match at its very start isn't one, as what is before isn't seen.
    """
    subject = F.col(text)
    found = []
    for d in tuple(text_detectors() if detectors is None else detectors):
        runs = [c for c in (where(d), reduce(lambda a, b: a | b, (subject.contains(x) for x in d.literals)) if d.literals else None, subject.rlike(d.gate) if d.gate else None, ~subject.rlike(d.unless) if d.unless else None, F.col("is_datagram") if d.datagram_only else None) if c is not None]
        spans = _in_context(subject, d, ends).cast(_SHAPE) if isinstance(ends, Column) else _built(d, text, ends)
        found.append(F.when(reduce(lambda a, b: a & b, runs), spans).otherwise(F.array().cast(_SHAPE)) if runs else spans)
    others = [c for c in rows.columns if c != text]
    every = rows.where(subject.isNotNull()).select(*others, F.explode(F.concat(*found)).alias("__finding"))
    if cut is not None:
        every = every.where(~(cut & (F.col("__finding.match_start") == 0)))
    return every.select(*others, *(F.col(f"__finding.{c}").alias(c) for c in FINDING))
