"""Column expressions over text: positions of regular-expression matches, check digits, fields of queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though inner lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str, groups: Sequence[int] = ()) -> Column:
    """array<struct<start,stop,whole,g1,...>> of all matches, left to right; positions count characters from 0.

    What lies between matches and the matches themselves alternate, so running
    sums of their lengths give the positions without leaving the JVM. Many
    matches are summed in blocks of the square root of their number, as adding
    to an array copies it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), *parts)
    shape = "array<struct<start:int,stop:int,whole:string" + "".join(f",g{g}:string" for g in groups) + ">>"
    kept = ("whole", *(f"g{g}" for g in groups))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        stop = start + F.length(m["whole"])
        here = F.struct(start.alias("start"), stop.alias("stop"), *(m[c].alias(c) for c in kept))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(here).cast(shape)).alias("out"))

    empty = F.array().cast(shape)
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def in_blocks(found: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(found))).cast("int")
        walked = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(found, b * block + 1, block), zero, step))
        before = lambda w: F.aggregate(w, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        shifted = lambda x: F.transform(x["w"]["out"], lambda m: F.struct((m["start"] + x["at"]).alias("start"), (m["stop"] + x["at"]).alias("stop"), *(m[c].alias(c) for c in kept)))
        return let(walked, lambda w: F.flatten(F.transform(F.arrays_zip(w.alias("w"), before(w).alias("at")), shifted))).cast(shape)

    # the cheap test first: most texts have no match and skip the rest
    return F.when(text.rlike(pattern), let(zipped, lambda found: F.when(F.size(found) <= 64, F.aggregate(found, zero, step)["out"]).otherwise(in_blocks(found)))).otherwise(empty)


def luhn_valid(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def base64_bytes(text: Column) -> Column:
    """Bytes of standard or URL-safe base64, padded or not; null if malformed."""
    plain = F.rtrim(F.translate(text, "-_", "+/"), F.lit("="))
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64"))


def json_object(raw: Column) -> Column:
    """The object of UTF-8 JSON bytes as map<string,string>; null if it isn't a JSON object."""
    text = F.when(F.is_valid_utf8(F.decode(raw, "ISO-8859-1")), F.decode(raw, "ISO-8859-1"))
    return F.when(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>"))


def url_decoded(text: Column) -> Column:
    """Percent-decoding with plus as space; a malformed escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def query_fields(query: Column, most: int = 256) -> Column:
    """array<struct<name,encoded,value>> of ``&``- or ``;``-separated pairs that have a name and an equals sign."""
    pairs = F.filter(F.split(query, "[&;]"), lambda p: p.rlike("^[^=]{1,256}=[^=]{0,8192}") & (F.length(p) > 0))
    return F.slice(
        F.transform(
            pairs,
            lambda p: F.struct(
                url_decoded(F.substring_index(p, "=", 1)).alias("name"),
                F.regexp_replace(p, "^[^=]*=", "").alias("encoded"),
                url_decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("value"),
            ),
        ),
        1,
        most,
    )
