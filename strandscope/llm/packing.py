"""Best-fit packing of token pieces by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The
linear program (fewest configurations that cover the length histogram) is
solved by multiplicative weights: lengths that are covered less weigh more, and
a knapsack dynamic program prices the configuration of the largest weight for
each length. The fractional solution is rounded to whole configurations, and
best fit places the pieces that rounding leaves.

Only the histogram (at most one count for each length) reaches the driver.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import ByteLevelEncoder
from .workspace import Workspace

_ENCODERS: dict[str, ByteLevelEncoder] = {}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, if asked) of each document's ids plus ``end_id``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = ByteLevelEncoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for ident, ids in zip(batch["doc_id"], _ENCODERS[vocabulary].encode(batch["text"].tolist()), strict=True):
                ids += end
                n = len(ids) // 4
                start, piece, size = 0, 0, (n - 1) % capacity + 1
                while start < n:
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((ident, piece, start, size, zlib.crc32(part), *([part] if with_ids else [])))
                    start, piece, size = start + size, piece + 1, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, _PIECES + (", ids binary" if with_ids else ""))


def _price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best weight of each room, and the length taken last there (0: none)."""
    items = np.flatnonzero(weights > 0)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for room in range(1, capacity + 1):
        fit = items[: np.searchsorted(items, room, "right")]
        if len(fit):
            gain = best[room - fit] + weights[fit]
            k = int(gain.argmax())
            if gain[k] > best[room - 1]:
                best[room], took[room] = gain[k], fit[k]
                continue
        best[room] = best[room - 1]
    return best, took


def _filled(took: np.ndarray, first: int, capacity: int) -> tuple[int, ...]:
    """The best configuration that holds ``first``, by the lengths that the knapsack took."""
    config, room = [first], capacity - first
    while room > 0:
        if took[room]:
            config.append(int(took[room]))
        room -= int(took[room]) or 1
    return tuple(sorted(config, reverse=True))


def solve_configurations(counts: np.ndarray, capacity: int, *, rounds: int = 12, step: float = 0.3) -> tuple[list[tuple[tuple[int, ...], float]], int]:
    """A fractional cover of ``counts`` (index: length) by configurations, by multiplicative weights, and a lower bound of every cover.

    A length starts with the room that it takes as its weight. Each round
    prices, for every length, the best configuration that contains it under the
    weights, and multiplies the weight of a length by exp(step) to the power of
    how much less than the average of all lengths the round has covered it. Any
    weights give a bound: all pieces' weight over the weight of the best
    configuration.
    """
    wanted = np.flatnonzero(counts)
    weights = np.zeros(capacity + 1)
    weights[wanted] = wanted
    amounts: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for _ in range(rounds):
        best, took = _price(weights, capacity)
        bound = max(bound, float(weights @ counts) / best[capacity])
        covered = np.zeros(capacity + 1)
        for length in wanted:
            held = Counter(_filled(took, int(length), capacity))
            amount = min(counts[a] / b for a, b in held.items()) / rounds
            key = tuple(sorted(held.elements(), reverse=True))
            amounts[key] = amounts.get(key, 0.0) + amount
            for a, b in held.items():
                covered[a] += amount * b
        share = covered[wanted] * rounds / counts[wanted]
        weights[wanted] *= np.exp(step * (1 - share / share.mean()))
    load = np.zeros(capacity + 1)
    for config, x in amounts.items():
        for a in config:
            load[a] += x
    return [(c, x / max(load[a] / counts[a] for a in c)) for c, x in amounts.items()], math.ceil(bound - 1e-6)


def best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Configurations by best fit of decreasing lengths, over the histogram.

    Equal lengths are placed together, so the work depends on the number of
    different lengths and bins' states, not on the number of pieces.
    """
    open_bins: dict[int, Counter] = {}  # room -> contents -> number of bins
    rooms: list[int] = []
    done: Counter = Counter()

    def put(room: int, config: tuple[int, ...], n: int) -> None:
        if room == 0:
            done[config] += n
            return
        if room not in open_bins:
            open_bins[room] = Counter()
            bisect.insort(rooms, room)
        open_bins[room][config] += n

    for length in np.flatnonzero(counts)[::-1]:
        left, length = int(counts[length]), int(length)
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                break
            room = rooms[k]
            config, n = next(iter(open_bins[room].items()))
            n = min(n, left)
            open_bins[room][config] -= n
            if not open_bins[room][config]:
                del open_bins[room][config]
            if not open_bins[room]:
                del open_bins[room], rooms[k]
            put(room - length, (*config, length), n)
            left -= n
    for held in open_bins.values():
        done.update(held)
    return done


def _rounded(counts: np.ndarray, capacity: int) -> tuple[Counter, Counter, int]:
    """Whole configurations of the program, the best fit of what they leave, and the program's lower bound.

    The program is solved again for what a rounding leaves. A rounding uses the
    fullest configurations, those of long pieces first, as often as the
    program does, once at least, and while their pieces last. It ends when the
    configurations leave more room than best fit of the same pieces does.
    """
    left, used, least = counts.copy(), Counter(), 0
    while left.any():
        solution, bound = solve_configurations(left, capacity)
        least = least or bound
        rest = best_fit(left, capacity)
        spare = (sum(rest.values()) * capacity - int(left @ np.arange(capacity + 1))) / sum(rest.values())
        took = 0
        for config, x in sorted(solution, key=lambda c: (sum(c[0]), c[0], c[1]), reverse=True):
            if capacity - sum(config) > spare:
                break
            held = Counter(config)
            times = min(max(1, int(x)), *(int(left[a]) // b for a, b in held.items()))
            if times > 0:
                used[config] += times
                took += times
                for a, b in held.items():
                    left[a] -= times * b
        if not took:
            return used, rest, least
    return used, Counter(), least


def pack_histogram(counts: np.ndarray, capacity: int) -> Counter:
    """Configurations (lengths in the order of their places) and how often each is used; they hold exactly ``counts``.

    The rounded program with best fit of its rest, unless best fit of all
    pieces needs fewer sequences.
    """
    left = counts.astype(np.int64).copy()
    full = Counter({(capacity,): int(left[capacity])} if left[capacity] else {})
    left[capacity] = 0
    if left.any():
        used, rest, _ = _rounded(left, capacity)
        full.update(min((used + rest, best_fit(left, capacity)), key=lambda c: sum(c.values())))
    return full


def _places(used: Counter, capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length: first rank, first sequence and offset of each run of equal places."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at: Counter = Counter()
    base = 0
    for config, times in used.items():
        offset = 0
        for length in config:
            rows.setdefault(length, []).append((at[length], base, offset))
            at[length] += times
            offset += length
        base += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*held, strict=True)) for length, held in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int, *, rows_per_salt: int = 500_000) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length of 1 to ``capacity``, ...).

    Pieces of a length are ranked by (salt, doc_id, piece): counts for each
    (length, salt) are summed in a window over the few salts of a length, and
    no task ranks more than one salt's share of the most frequent length.
    """
    spark = pieces.sparkSession
    salted = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 20))
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    salts = max(32, -(-int(counts.max()) // rows_per_salt))
    # At most one run of places for each entry of a configuration: bounded by rounds and capacity, not by rows.
    places = spark.sparkContext.broadcast(_places(pack_histogram(counts, capacity), capacity))
    rows = pieces.withColumn("salt", F.pmod(salted, F.lit(salts)).cast("int"))
    sums = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = sums.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    # before the join the ranks are local to a salt; (length, salt) is the key of both sides
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                first, base, off = places.value[int(length)]
                k = np.searchsorted(first, ranks[here], "right") - 1
                sequence[here], offset[here] = base[k] + ranks[here] - first[k], off[k]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*[c for c in ranked.columns if c != "rank"]).schema)
    return ranked.mapInPandas(place, f"{shape}, sequence_id long, offset long").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked).

    A document's ids are those of its whole text and then ``end_id``; a null
    text is empty and gives one piece of length 1. Documents longer than
    ``capacity`` are cut into full pieces after a first piece that takes the
    remainder. Rows are packed as they are: repeated rows are packed each; a
    null id stays null. Other columns are not read; an empty table gives no
    rows. Sequences have gapless offsets from 0.
    """
    space = Workspace(docs.sparkSession)
    pieces = space.table(token_pieces(docs, vocabulary, capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, capacity)
