"""Ranked lexical search: an inverted index of compressed posting blocks, searched by block-max WAND.

The index is a table. Documents are cut into segments of bounded size, each
built by one task without an exchange; a segment has one row for each of its
terms, whose postings are kept in blocks of BLOCK documents: gaps and
frequencies in bytes of variable number, and for each block its last document,
the largest impact in it and where it ends.

A search meets each segment with all queries. The pointers of a query's terms
first move shallowly, over block headers alone: between two ends of blocks the
sum of the blocks' weighted maxima bounds every score, and stretches whose
bound is below the threshold, the k-th best score so far, are skipped with
their blocks still compressed. In the others, document gaps are decompressed,
and a document becomes a pivot only if the maxima of the lists that hold it
reach the threshold; frequencies are decompressed for pivots alone. A task's
threshold carries over from segment to segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import terms
from .workspace import Workspace

#: Documents of a posting block.
BLOCK = 64
#: Terms, and documents, after which a segment is closed.
SEGMENT_TERMS, SEGMENT_DOCS = 1_000_000, 1 << 16
#: Distinct terms of the queries that are sent to the executors at a time; more queries take more passes over the index.
QUERY_TERMS = 100_000
#: Stretches of a segment whose documents are looked at before the threshold is taken anew.
STRETCHES = 512

_INDEX = "segment long, term string, df long, head binary, docs binary, tfs binary"


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, seven bits each, lowest first, the last of a value below 128; and the number of bytes of each."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[has] + k] = (values[has] >> (7 * k)) & 127 | (size[has] > k + 1) << 7
    return out, size


def unvarint(data: np.ndarray) -> np.ndarray:
    last = data < 128
    starts = np.flatnonzero(np.r_[True, last[:-1]])
    if len(starts) == len(data):
        return data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def _binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    offsets = np.r_[0, ends].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of a document of n terms; the product of 90, n and ``documents`` has to stay within 64 bits."""
    return 10 + (90 * n * documents) // max(1, words)


def segment_rows(number: int, ids: list[int | None], doc: np.ndarray, term: pa.Array, documents: int, words: int) -> pa.RecordBatch:
    """Rows of _INDEX of a segment: first its documents (no term: m, ids and which ids are there), then its terms in order."""
    count = len(ids)
    m = length_norm(np.bincount(doc, minlength=count).astype(np.int64), documents, words)
    coded = term.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, tf = np.unique(rank[coded.indices.to_numpy()] * max(1, count) + doc, return_counts=True)
    of, at = key // max(1, count), key % max(1, count)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    df = np.diff(np.r_[first, len(of)])
    place = np.arange(len(of)) - np.repeat(first, df)
    gap = np.where(place == 0, at, at - np.r_[0, at[:-1]] - 1)
    docs, doc_size = varint(gap)
    tfs, tf_size = varint(tf.astype(np.int64))
    doc_end, tf_end = np.cumsum(doc_size), np.cumsum(tf_size)
    head, blocks = np.zeros((0, 4), np.int32), np.zeros(0, np.int64)
    if len(of):
        starts = np.flatnonzero(place % BLOCK == 0)
        stops = np.r_[starts[1:], len(of)] - 1
        before = np.repeat(first, -(-df // BLOCK))  # first posting of each block's term
        blocks = np.cumsum(-(-df // BLOCK))
        head = np.column_stack([at[stops], np.maximum.reduceat(impact(tf.astype(np.int64), m[at]), starts), doc_end[stops] - (doc_end - doc_size)[before], tf_end[stops] - (tf_end - tf_size)[before]]).astype(np.int32)
    ends = first + df - 1
    own = pa.record_batch(
        [
            pa.array([number] * len(df), pa.int64()), coded.dictionary.take(pa.array(order)).cast(pa.string()), pa.array(df.astype(np.int64)),
            _binaries(head.tobytes(), blocks * 16), _binaries(docs.tobytes(), doc_end[ends] if len(of) else ends), _binaries(tfs.tobytes(), tf_end[ends] if len(of) else ends),
        ],
        names=_NAMES,
    )
    there = np.array([i is not None for i in ids], np.uint8)
    known = np.array([i or 0 for i in ids], np.int64)
    about = pa.record_batch([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([count], pa.int64()), pa.array([m.tobytes()], pa.binary()), pa.array([known.tobytes()], pa.binary()), pa.array([there.tobytes()], pa.binary())], names=_NAMES)
    return pa.Table.from_batches([about, own]).combine_chunks().to_batches()[0]


_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


@dataclass
class Index:
    """``table`` has the rows of all segments; ``documents`` and ``words`` count those with a term, and all terms."""

    table: DataFrame
    documents: int
    words: int
    segments: int


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_terms: int = SEGMENT_TERMS, segment_docs: int = SEGMENT_DOCS) -> Index:
    """Index every row of ``docs``; a null text has no terms. Rows that share an id, or have none, are documents of their own."""
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = words = 0
        for batch in batches:
            for part in terms.slices(batch, "text"):
                doc, _ = terms.split(part["text"])
                documents, words = documents + len(np.unique(doc)), words + len(doc)
        yield pa.record_batch([pa.array([documents], pa.int64()), pa.array([words], pa.int64())], names=["documents", "words"])

    documents, words = rows.select("text").mapInArrow(measure, "documents long, words long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, doc, term = [], [], []

        def close() -> pa.RecordBatch:
            return segment_rows(number, ids, np.concatenate(doc), pa.concat_arrays(term), documents, words)

        for batch in batches:
            for part in terms.slices(batch, "text"):
                d, t = terms.split(part["text"])
                doc.append(d.astype(np.int64) + len(ids))
                term.append(t)
                ids += part["doc_id"].to_pylist()
                if sum(map(len, doc)) >= segment_terms or len(ids) >= segment_docs:
                    yield close()
                    number += 1
                    ids, doc, term = [], [], []
        if ids:
            yield close()

    table = space.table(rows.mapInArrow(build, _INDEX), "index")
    return Index(table, documents, words, table.where("term is null").count())


class _Postings:
    """One term's list in a segment: headers, and what has been decompressed of it so far."""

    def __init__(self, df: int, head: bytes, docs: bytes, tfs: bytes):
        self.last, self.best, self.doc_end, self.tf_end = np.frombuffer(head, np.int32).reshape(-1, 4).T.astype(np.int64)
        self.padded = np.r_[self.best, 0]  # past its end a list adds nothing
        self.raw = np.frombuffer(docs, np.uint8), np.frombuffer(tfs, np.uint8)
        self.docs, self.tfs = np.empty(df, np.int64), np.empty(df, np.int64)
        self.open = np.zeros((2, len(self.last)), bool)
        self.df = df

    def _need(self, which: int, blocks: np.ndarray) -> None:
        """Decompress the ``blocks`` (ascending) that haven't been: documents (0) or frequencies (1)."""
        new = blocks[~self.open[which][blocks]]
        if not len(new):
            return
        self.open[which][new] = True
        ends, to = (self.doc_end, self.docs) if which == 0 else (self.tf_end, self.tfs)
        cuts = np.flatnonzero(np.diff(new) > 1) + 1
        for run in np.split(new, cuts):
            a, b = int(run[0]), int(run[-1]) + 1
            values = unvarint(self.raw[which][ends[a - 1] if a else 0 : ends[b - 1]])
            if which == 0:
                values = np.cumsum(values + 1) + (self.last[a - 1] if a else -1)
            to[a * BLOCK : a * BLOCK + len(values)] = values

    def places(self, blocks: np.ndarray) -> np.ndarray:
        """Places of the postings of ``blocks``, whose documents are decompressed."""
        self._need(0, blocks)
        out = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        return out[out < self.df]

    def frequencies(self, places: np.ndarray) -> np.ndarray:
        self._need(1, np.unique(places // BLOCK))
        return self.tfs[places]


class Best:
    """The k best documents of a query so far, ordered by falling score and ascending id, documents without one last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def threshold(self) -> int:
        """What a document has to reach to enter: the k-th best score, as its id may be the smaller one."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids, there = scores[keep], ids[keep], there[keep]
        rows = self.rows + [(int(s), int(i) if h else None) for s, i, h in zip(scores, ids, there, strict=True)]
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


@dataclass
class _Segment:
    m: np.ndarray
    ids: np.ndarray
    there: np.ndarray
    lists: dict[str, _Postings]


def search_segment(segment: _Segment, query: list[tuple[str, int]], best: Best) -> None:
    """Add a segment's best documents for a query, given as distinct terms with their weights, to ``best``."""
    lists = [(w, p) for t, w in query if w > 0 and (p := segment.lists.get(t))]
    if not lists:
        return
    # shallow moves: between two ends of blocks, each pointer stands at one block
    stops = np.unique(np.concatenate([p.last for _, p in lists])) + 1
    starts = np.r_[0, stops[:-1]]
    at = [np.searchsorted(p.last, starts) for _, p in lists]
    bound = np.zeros(len(starts), np.int64)
    for (w, p), b in zip(lists, at, strict=True):
        bound += w * p.padded[b]
    for first in range(0, len(starts), STRETCHES):
        here = slice(first, first + STRETCHES)
        live = bound[here] >= best.threshold
        if not live.any():
            continue
        lo, hi = int(starts[here][0]), int(stops[here][-1])
        wanted = np.repeat(live, stops[here] - starts[here])
        reach = np.zeros(hi - lo, np.int64)
        held = []
        for (w, p), b in zip(lists, at, strict=True):
            blocks = np.unique(b[here][live])
            blocks = blocks[blocks < len(p.last)]
            if not len(blocks):
                continue
            places = p.places(blocks)
            docs = p.docs[places] - lo
            inside = (docs >= 0) & (docs < hi - lo)
            places, docs = places[inside], docs[inside]
            inside = wanted[docs]
            places, docs = places[inside], docs[inside]
            reach[docs] += w * p.best[places // BLOCK]
            held.append((w, p, places, docs))
        pivot = reach >= best.threshold
        if not pivot.any():
            continue
        score = np.zeros(hi - lo, np.int64)
        for w, p, places, docs in held:
            on = pivot[docs]
            if on.any():
                docs = docs[on]
                score[docs] += w * impact(p.frequencies(places[on]), segment.m[docs + lo])
        found = np.flatnonzero(score >= best.threshold)
        if len(found):
            best.add(score[found], segment.ids[found + lo], segment.there[found + lo])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[_Segment]:
    """Segments of rows that come sorted by segment and term."""
    number, held = None, None
    for batch in batches:
        cols = [batch.column(c) for c in _NAMES]
        for s, t, df, head, docs, tfs in zip(*(c.to_pylist() for c in cols), strict=True):
            if s != number:
                if held:
                    yield held
                number, held = s, None
            if t is None:
                held = _Segment(np.frombuffer(head, np.int64), np.frombuffer(docs, np.int64), np.frombuffer(tfs, np.uint8).astype(bool), {})
            else:
                held.lists[t] = _Postings(df, head, docs, tfs)
    if held:
        yield held


def _blocks(queries: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Queries (row, distinct terms) in blocks of at most ``most`` distinct terms, or of one query."""
    block, known = [], set()
    for r in queries.orderBy("query").toLocalIterator():
        if block and len(known | set(r["terms"])) > most:
            yield block
            block, known = [], set()
        block.append((r["query"], list(r["terms"])))
        known.update(r["terms"])
    if block:
        yield block


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(index: Index, items: DataFrame, *, k: int = 10, item_col: str = "item_id", text_col: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item, or all if there are fewer.

    Equal scores rank by ascending doc_id, documents without one last. Every
    row of ``items`` is a query of its own, also those that repeat an id; null
    and empty texts, and items of which no document has a term, give no rows.
    Queries are sent out in blocks of at most ``query_terms`` distinct terms,
    each a pass over its terms' rows of the index; results don't depend on the
    blocks, nor on segments and partitions.
    """
    spark = items.sparkSession
    space = Workspace(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({terms.fold(t) for t in terms.TERM.findall(x or "")}) for x in batch["text"].to_pylist()]
            yield pa.record_batch([batch["query"], batch["item_id"], pa.array(own, pa.list_(pa.string()))], names=["query", "item_id", "terms"])

    held = items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    held = space.table(held.mapInArrow(read, "query long, item_id long, terms array<string>"), "queries")
    parts = max(1, min(index.segments, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))

    def passed(block: list[tuple[int, list[str]]]) -> DataFrame:
        own = sorted({t for _, ts in block for t in ts})
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in own], "term string"))  # at most query_terms, or one query's
        rows = index.table.join(wanted, "term", "left_semi")
        df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weighted = [(q, [(t, weight(index.documents, df[t])) for t in ts if t in df]) for q, ts in block]
        shared = spark.sparkContext.broadcast([x for x in weighted if x[1]])

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {q: Best(k) for q, _ in shared.value}
            for segment in _segments(batches):
                for q, query in shared.value:
                    search_segment(segment, query, best[q])
            out = [(q, i, s) for q, b in best.items() for s, i in b.rows]
            yield pa.record_batch([pa.array([r[n] for r in out], pa.int64()) for n in range(3)], names=["query", "doc_id", "score"])

        met = rows.select(*_NAMES).unionByName(index.table.where("term is null"))
        return met.repartition(parts, "segment").sortWithinPartitions("segment", F.asc_nulls_first("term")).mapInArrow(match, "query long, doc_id long, score long")

    out = spark.createDataFrame([], "query long, doc_id long, score long")
    for block in _blocks(held.where(F.size("terms") > 0).select("query", "terms"), query_terms):
        out = out.unionByName(passed(block))
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return ranked.join(held.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
