"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): the weights are shared by all
thresholds, which are ordered. x marks the hashed words of the whole text. The
model is fitted in numpy on a bounded sample of labelled documents, and every
document gets its expected severity, the sum over k of P(grade > k).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that the model is fitted on.
SAMPLE = 20_000
BITS = 20
_WORD = re.compile(r"\w+")


class _Features(dict):
    """Feature of each word; starts anew when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        return h


_FEATURES = _Features()


def features(text: str | None) -> list[int]:
    """Hashed features of the distinct words of a text, in lower case."""
    return list({_FEATURES[w] for w in set(_WORD.findall(text.lower()))}) if text else []


def sketch(text: str | None, words: int = 5) -> list[int]:
    """Four minimum hashes of the text's word shingles, one of which two near copies share almost surely."""
    own = text.lower().split() if text else []
    if len(own) < words:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(own[i : i + words]).encode("utf-8", "surrogatepass")) for i in range(len(own) - words + 1)], np.uint64)
    return [int((h * np.uint64(odd)).min().view(np.int64)) for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def without_copies(sketches: Sequence[Sequence[int] | np.ndarray]) -> list[int]:
    """Places of the rows that share no minimum hash with an earlier one of these."""
    seen: list[set[int]] = []
    kept = []
    for i, own in enumerate(sketches):
        keys = [int(x) for x in own]
        seen += (set() for _ in keys[len(seen) :])
        if not any(k in held for k, held in zip(keys, seen, strict=False)):
            kept.append(i)
            for k, held in zip(keys, seen, strict=False):
                held.add(k)
    return kept


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """``grades`` in ascending order, ``thresholds`` (one fewer), and the weights of the features kept in the model."""

    grades: np.ndarray
    thresholds: np.ndarray
    columns: np.ndarray
    weights: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each row and threshold."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(rows: Sequence[Sequence[int] | np.ndarray], grades: list[int], *, least_documents: int = 5, chance: float = 0.01, ridge: float = 0.1, steps: int = 300, rate: float = 0.5) -> OrdinalModel:
    """Maximum likelihood with a ridge on the weights, by Adam on the full sample.

    Features of fewer than ``least_documents`` sampled documents are left out,
    and so are those whose score test against the model without features isn't
    significant at ``chance`` for all features together (Bonferroni).
    Without labels, or with a single grade, the model predicts that grade (or 0).
    """
    order = np.unique(np.asarray(grades, int)) if grades else np.zeros(1, int)
    y = np.searchsorted(order, np.asarray(grades, int))
    k = len(order) - 1
    lengths = np.array([len(r) for r in rows], int)
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if lengths.sum() else np.zeros(0, int)
    seen = np.bincount(flat, minlength=1 << BITS)
    columns = np.flatnonzero(seen >= least_documents)
    if k == 0 or not len(columns):
        shares = np.array([(y > j).mean() for j in range(k)]) if k else np.zeros(0)
        return OrdinalModel(order, -np.log(np.clip(shares, 1e-6, 1 - 1e-6) / (1 - np.clip(shares, 1e-6, 1 - 1e-6))), columns[:0], np.zeros(0))
    place = np.full(1 << BITS, -1)
    place[columns] = np.arange(len(columns))
    owner, col = np.repeat(np.arange(len(rows)), lengths), place[flat]
    owner, col = owner[col >= 0], col[col >= 0]
    n = len(rows)
    shares = np.clip([(y > j).mean() for j in range(k)], 1e-4, 1 - 1e-4)
    start = -np.log(shares / (1 - shares))
    kept = _significant(owner, col, len(columns), y, start, chance)
    columns, renumber = columns[kept], np.cumsum(kept) - 1
    owner, col = owner[kept[col]], renumber[col[kept[col]]]
    # thresholds as a first one and positive gaps, so that they stay in order
    params = np.concatenate([np.zeros(len(columns)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    f = len(columns)
    for t in range(1, steps + 1):
        w, gaps = params[:f], np.exp(np.minimum(params[f + 1 :], 5))
        theta = params[f] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(owner, w[col], n)
        above = _sigmoid(s[:, None] - theta[None, :])
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        rows_at = np.arange(n)
        p = np.maximum(edge[rows_at, y] - edge[rows_at, y + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        upper, lower = slope[rows_at, y] / p, slope[rows_at, y + 1] / p
        ds = lower - upper  # of the negative log-likelihood by the score
        dtheta = np.zeros(k)
        for j in range(k):
            dtheta[j] = upper[y == j + 1].sum() - lower[y == j].sum()
        grad = np.concatenate([np.bincount(col, ds[owner], f) + ridge * w, [dtheta.sum()], [gaps[j] * dtheta[j + 1 :].sum() for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params - rate / (1 + 4 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * 0.2
    gaps = np.exp(np.minimum(params[f + 1 :], 5))
    return OrdinalModel(order, params[f] + np.concatenate([[0], np.cumsum(gaps)]), columns, params[:f])


def _significant(owner: np.ndarray, col: np.ndarray, columns: int, y: np.ndarray, thresholds: np.ndarray, chance: float) -> np.ndarray:
    """Score test of each feature in the model that has thresholds only."""
    above = np.r_[1.0, _sigmoid(-thresholds), 0.0]
    slope = above * (1 - above)
    residual = (slope[y] - slope[y + 1]) / np.maximum(above[y] - above[y + 1], 1e-12)
    n = np.bincount(col, minlength=columns)
    z = np.abs(np.bincount(col, residual[owner], columns)) / np.sqrt(np.maximum(n * (1 - n / (len(y) + 1)), 1e-9) * max(residual.var(), 1e-12))
    return z > NormalDist().inv_cdf(1 - chance / 2 / max(1, columns))


def train(docs: DataFrame, labels: DataFrame, *, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents, those of the smallest hashes of their ids; whole texts are read.

    Labels without a grade and repeated labels of a document (all but the
    highest grade) are left out, as are all but the smallest text of an id; near copies weigh as one document. What reaches the driver are word hashes.
    """
    graded = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(grade_col).cast("int").alias("grade"))
    total = graded.count()
    share = min(1.0, sample / max(1, total))
    chosen = graded.where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= F.lit(min(int(share * 2**63), 2**63 - 1))).orderBy(F.xxhash64("id")).limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    texts = texts.groupBy("id", "grade").agg(F.min("text").alias("text"))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"].to_numpy(), "grade": b["grade"].to_numpy(), "words": [np.array(features(t), np.int32).tobytes() for t in b["text"]], "sketch": [sketch(t) for t in b["text"]]})

    # kept as arrays of bytes: as Python's numbers, the words of a sample of long documents are hundreds of MB
    rows = texts.mapInPandas(marked, "id long, grade int, words binary, sketch array<long>").toLocalIterator()
    got = sorted(((r["id"], r["grade"], bytes(r["words"]), np.array(r["sketch"], np.int64)) for r in rows), key=lambda r: r[:3])
    got = [got[i] for i in without_copies([r[3] for r in got])]
    return fit([np.frombuffer(words, np.int32) for _, _, words, _ in got], [grade for _, grade, _, _ in got])


def score_documents(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with severity (double), grade (int) and rejected (boolean).

    ``severity`` is the expected severity: the sum over thresholds of the
    probability that the grade is above, 0 to the number of grades less 1.
    ``grade`` is the most probable grade. A document is ``rejected`` if its
    severity reaches ``at``. Null and empty texts have severity 0 and the lowest
    grade; a text without a known word has what the thresholds alone give.
    Input columns named like a result are replaced; an empty table gives an
    empty result.
    """
    from .workspace import passed_through

    others = passed_through(docs, "severity", "grade", "rejected")
    thresholds, grades = model.thresholds, model.grades
    held = docs.sparkSession.sparkContext.broadcast((model.columns, model.weights))  # at most 2**BITS weights

    @F.pandas_udf("severity double, grade int")
    def severity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = np.zeros(1 << BITS)
        weights[held.value[0]] = held.value[1]
        for text in batches:
            marks = [features(t) for t in text]
            counts = [len(m) for m in marks]
            owner = np.repeat(np.arange(len(marks)), counts)
            flat = np.fromiter(chain.from_iterable(marks), np.int64, sum(counts))
            score = np.bincount(owner, weights[flat], len(marks)) if len(flat) else np.zeros(len(marks))
            above = _sigmoid(score[:, None] - thresholds[None, :])
            edges = np.c_[np.ones(len(marks)), above, np.zeros(len(marks))]
            grade = grades[(edges[:, :-1] - edges[:, 1:]).argmax(axis=1)]
            blank = np.array([t is None or t == "" for t in text], bool)
            yield pd.DataFrame({"severity": np.where(blank, 0.0, above.sum(axis=1)), "grade": np.where(blank, grades[0], grade).astype(np.int32)})

    rows = docs.select(*others, severity(F.col(text_col)).alias("__tx"))
    return rows.select(*others, "__tx.severity", "__tx.grade", (F.col("__tx.severity") >= at).alias("rejected"))
