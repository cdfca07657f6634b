"""Removal of repeated passages by overlapping windows of three lines, and of one or two long ones, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import passed_through


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, n, and two hashes of each three consecutive lines that are not all blank."""
    n = F.greatest(F.size("lines") - 2, F.lit(0))
    zipped = F.arrays_zip(*(F.slice("lines", i, n).alias(f"l{i}") for i in (1, 2, 3)))
    rows = docs.where(F.size("lines") >= 3).select("doc_id", "text_key", F.posexplode(zipped).alias("pos", "w"))
    three = [F.col("w.l1"), F.col("w.l2"), F.col("w.l3")]
    return rows.where(F.trim(F.concat(*three)) != "").select("doc_id", "text_key", "pos", F.lit(3).alias("n"), F.xxhash64(*three).alias("h1"), F.hash(*three).alias("h2"))


def _short_windows(docs: DataFrame, words: int) -> DataFrame:
    """The same of each one line and each two consecutive lines of more than ``words`` words."""
    size = F.size("lines")
    parts = []
    for n in (1, 2):
        count = F.greatest(size - (n - 1), F.lit(0))
        zipped = F.arrays_zip(*(F.slice("lines", i, count).alias(f"l{i}") for i in range(1, n + 1)))
        held = [F.col(f"w.l{i}") for i in range(1, n + 1)]
        text = F.concat_ws(" ", *held)
        # so many words need a character each and one between them, which is the cheaper test
        long = (F.length(text) > 2 * words) & (F.size(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")) > words)
        rows = docs.where(size >= n).select("doc_id", "text_key", F.posexplode(zipped).alias("pos", "w"))
        parts.append(rows.where(long).select("doc_id", "text_key", "pos", F.lit(n).alias("n"), F.xxhash64(*held).alias("h1"), F.hash(*held).alias("h2")))
    return parts[0].unionByName(parts[1])


def repeated_positions(docs: DataFrame, short_words: int | None = None) -> DataFrame:
    """doc_id, text_key and starts (array of pos and n): windows that occurred before, in order of doc_id, text_key and position.

    ``docs`` has ``doc_id``, ``text_key`` and ``lines``. A frequent window is one row a task
    before the first exchange, and its occurrences meet the table of repeated
    windows (one row each) in a join, which Spark can split.
    """
    windows = _windows(docs)
    if short_words is not None:
        windows = windows.unionByName(_short_windows(docs, short_words))
    first = windows.groupBy("n", "h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first")).where("times > 1").drop("times")
    later = windows.join(first, ["n", "h1", "h2"]).where(F.struct("doc_id", "text_key", "pos") > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "n")).alias("starts"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", short_words: int | None = None) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and n_lines, n_removed (int), removed (array of int, ascending).

    Lines are what newlines separate. Every three consecutive lines form a
    window; windows overlap. Of equal windows the first one in order of
    document id and position stays; the lines that later ones cover are merged
    and removed. Windows of three blank lines are ignored. With
    ``short_words``, every one or two consecutive lines of more than so many
    words together are a window too, in documents of any number of lines;
    without it, documents of fewer than three lines are ignored. A null text
    stays null with 0 lines; an empty one has one line. A document of which
    every line goes keeps an empty text. Rows that share an id are told apart by
    their texts, in the order of a hash of it; rows that repeat both are one
    document, so what is removed from one is removed from the other. A null id
    sorts first. Input columns named like a result are replaced; an empty table
    gives an empty result.
    """
    others = passed_through(docs, text_col, "n_lines", "n_removed", "removed", "__ld_id", "__ld_key", "__ld_lines", "__ld_starts")
    ident, key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text_col)
    cut = docs.select(*others, ident.alias("__ld_id"), key.alias("__ld_key"), F.split(text_col, "\n", -1).alias("__ld_lines"))
    starts = repeated_positions(docs.select(ident.alias("doc_id"), key.alias("text_key"), F.split(text_col, "\n", -1).alias("lines")), short_words)
    found = cut.join(starts.select(F.col("doc_id").alias("__ld_id"), F.col("text_key").alias("__ld_key"), F.col("starts").alias("__ld_starts")), ["__ld_id", "__ld_key"], "left")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("__ld_starts", lambda w: F.sequence(w["pos"], w["pos"] + w["n"] - 1)))))
    n = F.when(F.col("__ld_lines").isNull(), 0).otherwise(F.size("__ld_lines"))
    found = found.select("*", F.when(n > 0, F.array_intersect(F.coalesce(covered, F.array().cast("array<int>")), F.sequence(F.lit(0), n - 1))).otherwise(F.array().cast("array<int>")).alias("removed"))
    left = F.array_except(F.sequence(F.lit(0), n - 1), "removed")
    text = F.when(F.size("removed") == 0, F.array_join("__ld_lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__ld_lines", i)), "\n"))
    return found.select(*others, F.when(F.col("__ld_lines").isNotNull(), text).alias(text_col), n.alias("n_lines"), F.size("removed").alias("n_removed"), F.col("removed")).select(
        *(c if c.lower() != text_col.lower() else text_col for c in _order(docs.columns, others, text_col)), "n_lines", "n_removed", "removed"
    )


def _order(columns: list[str], others: list[str], text_col: str) -> list[str]:
    held = {c.lower() for c in others} | {text_col.lower()}
    return [c for c in columns if c.lower() in held]
