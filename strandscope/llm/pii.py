"""Personal data by patterns, and the terms that give it away by how often they stand beside it.

Fixed patterns find the protected entities: e-mail addresses, IP addresses,
card and phone numbers. A term may reveal an entity as well as the entity's own
text does. With c an entity and t a term that stands within a few words of it,
documents of the corpus give

    PMI(c; t) = log2( N n(c, t) / (n(c) n(t)) ),   IC(c) = log2( N / n(c) ),

and PMI / IC is the share of what c tells that t already tells: 1 where t is
in no other context, and at most 0 where t says nothing of c. Terms above a
threshold are personal data too where they stand beside c: they are
generalised, or removed where they tell nearly all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms
from .workspace import Workspace, passed_through

KINDS = ("email", "ip", "card", "phone", "term")
# An address is looked for from its "@": what stands before it can't have another.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost match never begins within digits, as it would have begun with the first of them.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Terms on either side of an entity that are its context.
CONTEXT = 8
#: Different texts in which a term has to stand beside an entity before their numbers count.
SUPPORT = 3
#: Share of an entity's information from which a term is generalised, and from which it is removed.
DISCLOSURE, REMOVAL = 0.8, 0.95


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # what is before belongs to the last address
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Rank of the kind, start and end (code points) of every entity, by kind and start. Time is linear in the text."""
    out = [(0, *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def entity(rank: int, value: str) -> str:
    """The name under which an entity is counted: addresses without case, numbers by their digits."""
    return f"{KINDS[rank]}:{value.lower() if rank < 2 else _NOT_DIGIT.sub('', value)}"


def contexts(text: str, spans: list[tuple[int, int, int]], width: int = CONTEXT) -> list[tuple[str, str, int, int]]:
    """Entity, term, start and end of every term within ``width`` terms of an entity; terms that touch an entity are its own."""
    if not spans:
        return []
    stretches = sorted((a, b) for _, a, b in spans)
    free, at = [], 0
    for m in terms.TERM.finditer(text):
        while at < len(stretches) and stretches[at][1] <= m.start():
            at += 1
        # spans may lie within each other, so the next few are looked at too
        if not any(a < m.end() and m.start() < b for a, b in stretches[at : at + 4]):
            free.append(m.span())
    starts = np.array([a for a, _ in free], np.int64)
    out = []
    for rank, a, b in spans:
        name = entity(rank, text[a:b])
        left, right = np.searchsorted(starts, [a, b])
        out += [(name, terms.fold(text[s:e]), s, e) for s, e in free[max(0, left - width) : right + width]]
    return out


_SPAN = "struct<rank:int,start:int,stop:int,removed:boolean>"
_FOUND = f"row long, doc_id long, digest string, base array<{_SPAN}>, entities array<string>, context array<struct<entity:string,term:string,start:int,stop:int>>"


def _scan(rows: DataFrame, width: int) -> DataFrame:
    """_FOUND of rows with row, doc_id and text."""
    span = pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("removed", pa.bool_())])
    beside = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, named, near = [], [], []
            for value in batch["text"]:
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([{"rank": k, "start": a, "stop": b, "removed": True} for k, a, b in spans])
                named.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                near.append([dict(zip(("entity", "term", "start", "stop"), c, strict=True)) for c in contexts(text, spans, width)])
            cols = [batch["row"], batch["doc_id"], batch["digest"], pa.array(base, pa.list_(span)), pa.array(named, pa.list_(pa.string())), pa.array(near, pa.list_(beside))]
            yield pa.record_batch(cols, names=["row", "doc_id", "digest", "base", "entities", "context"])

    return rows.select("row", "doc_id", F.md5("text").alias("digest"), "text").mapInArrow(find, _FOUND)


def term_frequency(rows: DataFrame) -> DataFrame:
    """term and n, the rows whose ``text`` has it, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in terms.slices(batch, "text"):
                doc, term = terms.split(part["text"])
                coded = term.dictionary_encode()
                pairs = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, part.num_rows) + doc)
                n = np.bincount(pairs // max(1, part.num_rows), minlength=len(coded.dictionary))
                yield pa.record_batch([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], names=["term", "n"])

    return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(found: DataFrame, rows: DataFrame, *, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """entity, term and share of every term that discloses an entity beside which it stands.

    Numbers are of documents; copies of a text count for the shares, on both
    sides of each quotient, but are one text for ``support``.
    """
    total = rows.count()
    # rows of a text that many documents share meet in one row before pairs are counted
    pairs = found.select("digest", "row", F.explode(F.array_distinct(F.transform("context", lambda c: F.struct(c["entity"].alias("entity"), c["term"].alias("term"))))).alias("c"))
    pairs = pairs.groupBy("c.entity", "c.term", "digest").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("texts"))
    pairs = pairs.where(F.col("texts") >= support)
    named = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    joined = pairs.join(named, "entity").join(term_frequency(rows).withColumnRenamed("n", "n_term"), "term")
    told = F.log2(F.col("together") * float(total) / (F.col("n_entity") * F.col("n_term").cast("double")))
    joined = joined.where(F.col("n_entity") < total).withColumn("share", told / F.log2(F.lit(float(total)) / F.col("n_entity")))
    return joined.where(F.col("share") >= disclosure).select("entity", "term", "share")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (rank, start, stop, removed) by kind and start.

    ``rank`` indexes KINDS; positions are code points from 0, ends exclusive.
    ``base`` has the four kinds of patterns, whose matches are all to be
    removed; ``spans`` also the terms that disclose an entity of the same
    document beside which they stand. Null and empty texts have no spans. Every
    row is a document, whatever ids repeat or are null. Other columns are not
    read; an empty table gives no rows; very long texts are searched whole.
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = space.table(_scan(rows, context), "found")
    return _with_terms(found, rows, support, disclosure, removal).select("doc_id", "base", "spans")


def _with_terms(found: DataFrame, rows: DataFrame, support: int, disclosure: float, removal: float) -> DataFrame:
    telling = disclosures(found, rows, support=support, disclosure=disclosure)
    beside = found.where(F.size("context") > 0).select("row", F.explode("context").alias("c")).select("row", "c.*").join(telling, ["entity", "term"])
    beside = beside.groupBy("row", "start", "stop").agg(F.max("share").alias("share"))
    span = F.struct(F.lit(KINDS.index("term")).alias("rank"), "start", "stop", (F.col("share") >= removal).alias("removed")).cast(_SPAN)
    added = beside.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("added"))
    return found.join(added, "row", "left").withColumn("spans", F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))))


def replaced(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """``text`` with its entities, and terms to be removed, replaced by their kind in brackets, and other terms by their general form.

    The general form keeps whether a term has digits, begins with a capital or
    is another word. Where spans overlap, the one that begins first is
    replaced, with all that the others reach beyond it.
    """
    out, at, done = [], 0, 0
    for start, stop, rank, removed in sorted((a, b, k, r) for k, a, b, r in spans):
        if start < done:
            at = done = max(done, stop)
            continue
        value = text[start:stop]
        general = "[NUMBER]" if any(c.isdigit() for c in value) else "[NAME]" if value[:1].isupper() else "[WORD]"
        out += [text[at:start], f"[{KINDS[rank].upper()}]" if removed else general]
        at = done = stop
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """``docs`` with its texts sanitised, null ones staying null, and ``n_spans``, which replaces a column of that name."""
    space = Workspace(docs.sparkSession)
    others = passed_through(docs, "__row", "n_spans")
    held = space.table(docs.select(*others).withColumn("__row", F.monotonically_increasing_id()), "rows")
    rows = held.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = space.table(_scan(rows, context), "found")
    spans = _with_terms(found, rows, support, disclosure, removal).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def clean(text, marked):
        return text.combine(marked, lambda t, s: t if t is None else replaced(t, [(x["rank"], x["start"], x["stop"], x["removed"]) for x in s]))

    out = held.join(spans, "__row").withColumn("n_spans", F.size("__spans"))
    return out.withColumn(text_col, clean(F.col(text_col), F.col("__spans"))).select(*others, "n_spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each, with commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
