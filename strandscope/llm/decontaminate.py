"""Benchmark decontamination by a BM25 inverted index of the test items, searched with block-max WAND.

Every passage (overlapping window of words) of every training document is a
query. Items are searched with windows of their own class of length, and term
frequencies and lengths are those of all items, so what is found of an item
doesn't depend on the items that it is indexed with. An item's BM25 score is divided by the score that the item gets from its
own words, so one threshold serves all items, and all items above it are
retrieved. A retrieved item is verified on the five-word shingles of its
question and answer that occur around the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, passed_through

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.5
#: Items that are indexed, and sent to the executors, at a time; more items take more passes, with the same results.
BLOCK_ITEMS = 20_000
#: Postings of a term that share a maximum.
POSTINGS_BLOCK = 16
#: Items for which a passage's bound is first taken together, and most such ranges.
ITEM_RANGE, ITEM_RANGES = 4, 100
#: Words of a text that are bounded at a time.
SEGMENT = 32_768


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer of an item given as one text: its last sentence answers; of a single sentence, the last fifth."""
    parts = _SENTENCE.split(text.strip()) if text else []
    if len(parts) > 1 and words(parts[-1]):
        return words(" ".join(parts[:-1])), words(parts[-1])
    own = words(text)
    cut = len(own) - math.ceil(len(own) / 5)
    return own[:cut], own[cut:]


def _shingles(own: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


@dataclass
class Statistics:
    """Of all items: how many there are, their mean length, and in how many each word is (of those asked for)."""

    items: int
    mean: float
    frequency: dict[str, int]


def statistics(items: list[tuple[int, list[str], list[str]]]) -> Statistics:
    frequency = Counter(w for _, q, a in items for w in {*q, *a})
    return Statistics(len(items), sum(len(q) + len(a) for _, q, a in items) / max(1, len(items)), frequency)


def window_of(length: int) -> int:
    """Words of the passages in which an item of ``length`` words is looked for: the power of two from there, 64 at least."""
    return max(64, 1 << max(0, length - 1).bit_length())


@dataclass
class Index:
    """Term ids; for each term the items (ascending), their normalised impacts, and the largest impact of each block."""

    terms: dict[str, int]
    items: list[list[int]]
    impacts: list[list[float]]
    block_max: list[list[float]]
    bound: np.ndarray
    range_bound: np.ndarray  # term x range of items: largest impact there
    parts: list[tuple[int, list[str], list[str]]]
    window: int


def build_indexes(items: list[tuple[int, list[str], list[str]]], known: Statistics | None = None) -> list[Index]:
    """An index for each class of length."""
    known = known or statistics(items)
    classes: dict[int, list[tuple[int, list[str], list[str]]]] = {}
    for item in items:
        classes.setdefault(window_of(len(item[1]) + len(item[2])), []).append(item)
    return [build_index(own, known) for _, own in sorted(classes.items())]


def build_index(items: list[tuple[int, list[str], list[str]]], known: Statistics | None = None, *, k1: float = 1.2, b: float = 0.75) -> Index:
    """``items``: id, question words, answer words. Items without words are in no posting. ``known`` is of all items (default: of these)."""
    known = known or statistics(items)
    texts = [q + a for _, q, a in items]
    counts = [Counter(t) for t in texts]
    mean = known.mean or 1.0
    terms = {w: i for i, w in enumerate(sorted({w for c in counts for w in c}))}
    idf = {w: math.log(1 + (known.items - (n := known.frequency[w]) + 0.5) / (n + 0.5)) for w in terms}
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, c in enumerate(counts):
        impact = {w: idf[w] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(texts[i]) / mean)) for w, n in c.items()}
        own = sum(impact.values())
        for w, x in impact.items():
            postings[terms[w]].append((i, x / own))
    blocks = [[max(x for _, x in p[at : at + POSTINGS_BLOCK]) for at in range(0, len(p), POSTINGS_BLOCK)] for p in postings]
    span = max(ITEM_RANGE, -(-len(items) // ITEM_RANGES))
    ranges = np.zeros((len(terms) + 1, max(1, -(-len(items) // span))), np.float32)
    for t, p in enumerate(postings):
        for i, x in p:
            ranges[t, i // span] = max(ranges[t, i // span], x * (1 + 1e-6))
    longest = max(map(len, texts), default=0)
    return Index(terms, [[i for i, _ in p] for p in postings], [[x for _, x in p] for p in postings], blocks, np.array([max(m) for m in blocks] + [0.0]), ranges, items, window_of(longest))


def search(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items (by place) whose score from the distinct ``terms`` reaches ``threshold``, by block-max WAND."""
    eps = threshold - 1e-9
    lists = [[index.items[t][0], 0, t] for t in terms if index.items[t]]  # current item, place in the list, term
    bound = index.bound
    found = []
    while lists:
        lists.sort()
        total, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(lists):
            total += bound[t]
            if total >= eps:
                pivot = k
                break
        if pivot < 0:
            return found
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        near, jump = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62
        for cursor in lists[: pivot + 1]:
            own, at, t = index.items[cursor[2]], cursor[1], cursor[2]
            block = at // POSTINGS_BLOCK
            last = min(len(own), (block + 1) * POSTINGS_BLOCK) - 1
            while own[last] < item and last + 1 < len(own):
                block += 1
                last = min(len(own), (block + 1) * POSTINGS_BLOCK) - 1
            if own[last] >= item:
                near += index.block_max[t][block]
                jump = min(jump, own[last] + 1)
        if near < eps:
            goal = max(jump, item + 1)  # no item before the nearest block end can reach the threshold
            moved = lists[: pivot + 1]
        elif lists[0][0] == item:
            score = sum(index.impacts[t][at] for _, at, t in lists[: pivot + 1])
            if score >= eps:
                found.append((item, score))
            goal, moved = item + 1, lists[: pivot + 1]
        else:
            goal, moved = item, [c for c in lists[: pivot + 1] if c[0] < item]
        for cursor in moved:
            own, at = index.items[cursor[2]], cursor[1]
            while at < len(own) and own[at] < goal:
                at += 1
            cursor[0], cursor[1] = (own[at] if at < len(own) else -1), at
        lists = [c for c in lists if c[0] >= 0]
    return found


def _promising(ids: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Start and distinct known terms of the passages in which some range of items could reach the threshold.

    The block maxima of a passage's distinct terms are summed for all passages
    and all ranges of items at once.
    """
    width, none = index.window, len(index.bound) - 1
    stride = width // 2
    passages = max(1, -(-(len(ids) - stride) // stride))
    padded = np.full((passages + 1) * stride, none, np.int64)
    padded[: len(ids)] = ids
    views = np.lib.stride_tricks.sliding_window_view(padded, width)[::stride]
    for at in range(0, len(views), SEGMENT // stride):
        part = np.sort(views[at : at + SEGMENT // stride], axis=1)
        part[:, 1:][part[:, 1:] == part[:, :-1]] = none
        sums = np.zeros((len(part), index.range_bound.shape[1]), np.float32)
        row, _ = known = np.nonzero(part < none)
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums[row[first]] = np.add.reduceat(index.range_bound[part[known]], first, axis=0)
        for k in np.flatnonzero(sums.max(axis=1) >= threshold - 1e-5):
            yield (at + int(k)) * stride, part[k][part[k] < none]


def leaks(text: str | None, index: Index, *, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
    """item id, best score, question overlap and answer overlap of every verified item of a whole text."""
    own = words(text)
    get, none = index.terms.get, len(index.bound) - 1
    ids = np.array([get(w, none) for w in own], np.int64)
    width = index.window
    best: dict[int, tuple[int, float, float, float]] = {}
    for start, here in _promising(ids, index, threshold):
        for item, score in search(index, here.tolist(), threshold):
            ident, question, answer = index.parts[item]
            span = len(question) + len(answer)
            around = _shingles(own[max(0, start - span) : start + width + span])
            q, a = _shingles(question), _shingles(answer)
            # an answer shorter than a shingle is looked for as it is
            if a and len(answer) < SHINGLE:
                around = around | {tuple(own[i : i + len(answer)]) for i in range(max(0, start - span), min(len(own), start + width + span) - len(answer) + 1)}
            whole = _shingles(question + answer)
            shares = [len(x & around) / len(x) if x else 1.0 for x in (q, a, whole)]
            if whole and (min(shares[:2]) >= overlap or shares[2] >= overlap) and score > best.get(item, (0, -1.0))[1]:
                best[item] = (ident, score, shares[0], shares[1])
    return list(best.values())


_HIT = "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double"


def _items(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    """item, question and answer (words of each)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [split_item(q) if answer_col is None else (words(q), words(a)) for q, a in zip(b["question"], b["answer"], strict=True)]
            yield pd.DataFrame({"item": b["item"].astype("Int64"), "question": [q for q, _ in parts], "answer": [a for _, a in parts]})

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("question"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    return rows.mapInPandas(cut, "item long, question array<string>, answer array<string>")


def leaking(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id, score, question_overlap, answer_overlap of every verified leak of an item into a document.

    Items are read in blocks of ``block_items``, each indexed and sent out at a
    time, so what is broadcast is bounded whatever the benchmark's size; a block
    is a pass over the documents. Frequencies and lengths are taken over the
    whole benchmark first, so results don't depend on the blocks. Without
    ``answer_col`` the answer is the last sentence of the item's text. Items
    without words, null and empty documents match nothing. Repeated items and
    documents give their rows again. Passages start at every half window, and
    texts are searched whole. Other columns are not read; an empty table on
    either side gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where("text is not null")
    items = space.table(_items(benchmark, item_col, question_col, answer_col), "items")
    count, total = items.agg(F.count("*"), F.sum(F.size("question") + F.size("answer"))).first()
    frequency = space.table(items.select(F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "frequency")

    def scan(block: list[tuple[int, list[str], list[str]]]) -> DataFrame:
        own = sorted({w for _, q, a in block for w in (*q, *a)})
        wanted = spark.createDataFrame([(w,) for w in own], "word string")
        known = Statistics(count, total / count, {r["word"]: r["n"] for r in frequency.join(wanted, "word", "left_semi").collect()})
        held = spark.sparkContext.broadcast(build_indexes(block, known))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(d, k, *hit) for d, k, t in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True) for index in held.value for hit in leaks(t, index)]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in _HIT.split(", ")]).astype({"doc_id": "Int64", "text_key": "int64", "item_id": "Int64", "score": float, "question_overlap": float, "answer_overlap": float})

        return rows.mapInPandas(match, _HIT)

    out = spark.createDataFrame([], _HIT)
    ordered = ((r["item"], list(r["question"]), list(r["answer"])) for r in items.where(F.size("question") + F.size("answer") > 0).orderBy("item", "question", "answer").toLocalIterator())
    while block := list(islice(ordered, block_items)):
        out = out.unionByName(scan(block))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **given: object) -> DataFrame:
    """``leaking`` without text_key."""
    return leaking(docs, benchmark, **given).drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **given: object) -> DataFrame:
    """``docs`` without the rows in whose text an item was found; rows of one id are told apart by their texts, and those without an id stay."""
    bad = leaking(docs, benchmark, id_col=id_col, text_col=text_col, **given).select(F.col("doc_id").alias("__dc_id"), F.col("text_key").alias("__dc_key")).distinct()
    others = passed_through(docs, "__dc_id", "__dc_key")
    return docs.select(*others).join(bad, (F.col(id_col) == F.col("__dc_id")) & (F.xxhash64(text_col) == F.col("__dc_key")), "left_anti")
