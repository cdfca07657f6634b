"""Secret scanning with a battery of randomness tests, in DataFrame operations only.

Fixed patterns give the base spans. Every other long token is tested for
looking drawn at random from its encoding's alphabet, and tokens are accepted
by a false-discovery procedure over all documents, one family per length class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as text_functions
from .workspace import Workspace

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs of [0-9a-f]+ that have 16 characters
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}

# What ordinary words do, as the null hypothesis of the tests.
#: Chance that two letters of running text agree; in words of the letters a to f alone it is larger.
PROSE_COINCIDENCE = {"hex": 0.2, "HEX": 0.2, "base32": 0.07}
OTHER_COINCIDENCE = 0.065
PROSE_SWITCH = 0.08  # chance that neighbours differ in class (lower, upper, digit, other)
#: Chance at which a test of randomness rejects a token.
REJECT = 0.001


_SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


def _spans(text: Column, pattern: str, group: int, kind: str, least: int) -> Column:
    """array<struct<start,rank,stop,value>> of the leftmost non-overlapping matches whose group has ``least`` characters; positions are code points."""
    part = f"g{group}" if group else "whole"
    found = F.filter(text_functions.find_all(text, pattern, (group,) if group else ()), lambda m: F.length(m[part]) >= least)
    rank = F.lit(KINDS.index(kind))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), m["stop"].alias("stop"), m["whole"].alias("value"))).cast(_SPAN)


def _upper_tail(z: Column) -> Column:
    """Q(z) of the normal distribution (Abramowitz and Stegun 26.2.17), accurate in the tail too."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    q = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, q).otherwise(1 - q)


def randomness(tokens: DataFrame) -> DataFrame:
    """Add encoding, n, p_uniform, p_runs, p_serial and evidence_p to rows with ``token``.

    The encoding is the smallest alphabet that has all of the token's symbols.
    Tests of the token as a random one of its encoding, which it must pass:

    * uniformity: chi-squared of the symbol counts against the alphabet;
    * serial correlation of neighbouring symbol values, which is near 0 unless
      the token counts up, repeats or is a ramp (two-sided).

    Evidence that it isn't prose of the same alphabet: fewer coinciding pairs
    of symbols than prose has (the same statistic, by its distance from prose)
    and runs of character classes that are shorter (``p_runs``).
    ``evidence_p`` is the chance that prose shows so much of both (Stouffer).
    Tokens of digits only, and tokens that a test of randomness rejects at
    REJECT, are no evidence: 1.
    """
    core = F.regexp_replace("token", "=+$", "")
    classes = (("decimal", "0-9"), ("hex", "0-9a-f"), ("HEX", "0-9A-F"), ("base32", "A-Z2-7"), ("base36", "0-9a-z"), ("BASE36", "0-9A-Z"), ("base62", "0-9A-Za-z"))
    encoding = F.lit("base64")
    alphabet, chance = F.lit(ALPHABETS["base64"]), F.lit(OTHER_COINCIDENCE)
    for name, symbols in reversed(classes):
        encoding = F.when(core.rlike(f"^[{symbols}]*$"), name).otherwise(encoding)
    for name in PROSE_COINCIDENCE.keys() | ALPHABETS.keys():
        alphabet = F.when(F.col("encoding") == name, ALPHABETS[name]).otherwise(alphabet)
        chance = F.when(F.col("encoding") == name, PROSE_COINCIDENCE.get(name, OTHER_COINCIDENCE)).otherwise(chance)
    rows = tokens.withColumn("encoding", encoding).withColumn("symbols", F.filter(F.split(core, ""), lambda c: c != ""))
    rows = rows.withColumns({"alphabet": alphabet, "chance": chance, "n": F.size("symbols"), "ordered": F.array_sort("symbols")})
    n = F.col("n").cast("double")
    # sum over symbols of c(c-1)/2 = sum over the sorted symbols of the number of equal ones before each
    pairs = F.aggregate(
        "ordered",
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("pairs")),
        lambda a, c: F.struct(c.alias("last"), F.when(a["last"] == c, a["run"] + 1).otherwise(F.lit(0)).alias("run"), (a["pairs"] + F.when(a["last"] == c, a["run"] + 1).otherwise(F.lit(0)).cast("long")).alias("pairs")),
    )["pairs"]
    rows = rows.withColumn("pairs", pairs.cast("double"))
    # base64 comes with one or the other pair of its last symbols
    size = F.when(F.col("encoding") == "base64", 64.0).otherwise(F.length("alphabet").cast("double"))
    freedom = size - 1
    chi = size / n * (2 * F.col("pairs") + n) - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - 1 + 2 / (9 * freedom)) / F.sqrt(2 / (9 * freedom))  # Wilson and Hilferty
    k = F.col("chance")
    # three letters of text agree with about the power 1.86 of the chance of two
    mean, var = n * (n - 1) / 2 * k, n * (n - 1) / 2 * k * (1 - k) + n * (n - 1) * (n - 2) * F.greatest(F.pow(k, F.lit(1.86)) - k * k, F.lit(0.0))
    z_prose = (mean - F.col("pairs") - 0.5) / F.sqrt(var)
    klass = lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)
    zero = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("switches"), F.lit(None).cast("double").alias("x"), *(F.lit(0.0).alias(c) for c in ("sx", "sxx", "sxy", "first")))
    values = F.transform(F.col("symbols"), lambda c: F.struct(klass(c).alias("k"), F.call_function("instr", F.col("alphabet"), c).cast("double").alias("x")))

    def step(a: Column, s: Column) -> Column:
        return F.struct(
            s["k"].alias("k"),
            (a["switches"] + F.when((a["k"] >= 0) & (a["k"] != s["k"]), 1).otherwise(0)).alias("switches"),
            s["x"].alias("x"),
            (a["sx"] + s["x"]).alias("sx"),
            (a["sxx"] + s["x"] * s["x"]).alias("sxx"),
            (a["sxy"] + F.coalesce(a["x"] * s["x"], F.lit(0.0))).alias("sxy"),
            F.when(a["x"].isNull(), s["x"]).otherwise(a["first"]).alias("first"),
        )

    rows = rows.withColumn("walk", F.aggregate(values, zero, step))
    m = n - 1
    z_runs = (F.col("walk.switches") - 0.5 - m * PROSE_SWITCH) / F.sqrt(m * PROSE_SWITCH * (1 - PROSE_SWITCH))
    # cyclic lag-1 correlation: sum of neighbours' products against squares, both around the mean
    spread = F.col("walk.sxx") - F.col("walk.sx") * F.col("walk.sx") / n
    lagged = F.col("walk.sxy") + F.col("walk.x") * F.col("walk.first") - F.col("walk.sx") * F.col("walk.sx") / n
    r = F.when(spread > 0, lagged / spread).otherwise(1.0)
    p_serial = 2 * _upper_tail(F.abs(r + 1 / m) * F.sqrt(n))
    rows = rows.withColumn("p_uniform", _upper_tail(z_chi)).withColumn("p_runs", _upper_tail(z_runs)).withColumn("p_serial", F.least(p_serial, F.lit(1.0)))
    z = (z_prose + z_runs) / math.sqrt(2)
    usable = (F.col("encoding") != "decimal") & (F.col("p_serial") >= REJECT) & (F.col("p_uniform") >= REJECT)
    return rows.withColumn("evidence_p", F.when(usable, _upper_tail(z)).otherwise(1.0)).drop("symbols", "ordered", "alphabet", "chance", "walk", "pairs")


def discoveries(scored: DataFrame, rate: float) -> DataFrame:
    """Rows accepted at false-discovery rate ``rate`` by step-up tests within each length class (powers of two).

    p-values are counted in bins of a twentieth of a natural-log unit; a bin is
    accepted on its upper edge, so binning can only make the test stricter. The
    table of bins is at most 1,000 rows a class and 32 classes, at any size.
    """
    scored = scored.withColumn("length_class", F.floor(F.log2("n")).cast("int")).withColumn("bin", F.least(F.floor(-F.log(F.greatest("evidence_p", F.lit(1e-300))) * 20), F.lit(999)).cast("int"))
    bins = scored.groupBy("length_class", "bin").agg(F.count("*").alias("rows"))
    by_class = W.partitionBy("length_class")
    bins = bins.withColumn("as_small", F.sum("rows").over(by_class.orderBy(F.desc("bin")))).withColumn("all", F.sum("rows").over(by_class))
    passing = bins.where(F.exp(-F.col("bin") / 20) <= rate * F.col("as_small") / F.col("all"))
    limits = passing.groupBy("length_class").agg(F.min("bin").alias("least"))
    return scored.join(F.broadcast(limits), "length_class").where("bin >= least").drop("length_class", "bin", "least")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per document: doc_id and spans, array<struct<start,rank,stop,value>> ordered by start and kind.

    Positions are code points from 0, ends exclusive; ``rank`` indexes KINDS.
    The base kinds are as their patterns say. A token of 20 characters or more
    of the base64 alphabets that overlaps no base span is added as ``random``
    if the tests accept it. Null and empty texts have no spans. Every row is
    scanned for itself, whatever ids repeat or are null. Other columns are not read; an empty table
    gives no rows. Very long texts are scanned whole.
    """
    space = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SPAN)
    base = F.concat(F.when(text.rlike(ASSIGN_HINT), _spans(text, ASSIGN, 2, "assign", 12)).otherwise(none), _spans(text, ACCESS, 0, "access", 18), _spans(text, HEX, 0, "hex", 16))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", F.array_sort(base).alias("base"), _spans(text, TOKEN, 0, "random", 20).alias("tokens"))
    found = space.table(found.withColumn("row", F.monotonically_increasing_id()), "found")
    tokens = found.where(F.size("tokens") > 0).select("row", F.explode(F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))).alias("span"))
    added = discoveries(randomness(tokens.withColumn("token", F.col("span.value"))), rate).groupBy("row").agg(F.collect_set("span").alias("added"))
    joined = found.drop("tokens").join(added, "row", "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))
