"""Near-duplicate detection by BagMinHash signatures of weighted shingles.

A document is the multiset of its five-word shingles. For every shingle, a
Poisson process in time and weight gives points; the weight axis is cut into
dyadic levels (0,1], (1,2], (2,4], ..., each with a process of its own, and a
document sees the points below its shingle's count. The earliest point of each
of the signature's components is the same in two documents with probability
equal to their weighted Jaccard similarity. Points are generated in order of
time, and only up to the time at which a document's components are full.

Documents that agree in all rows of a band share a bucket, and candidates of a
bucket are verified on the exact overlap of their multisets. Links are not
expanded into pairs. Copies are folded first; a bucket proposes its most
central member to all others. Where that leaves several classes in a bucket,
rounds follow: a small bucket proposes all pairs between classes, a larger one
a few members to one representative of each other class, until a round joins
next to nothing. So the pairs of a round are linear in the members of buckets.
What then still shares a bucket across classes is compared in full, block
against block within a task, so that no link is lost and no pair is a row but
one link between a text and another class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
COMPONENTS = BANDS * ROWS
#: Members up to which a bucket's pairs are all compared.
SMALL = 8
#: Standard deviations below its expectation at which the agreement of two sketches rules a pair out (about one in a million of those at the similarity).
MARGIN = 4.7
#: Members of a larger bucket that are proposed to its classes in a round.
HUBS = 3
#: Share of the texts still compared that a round has to join for another one to follow; then all that is left is compared.
WORTH = 0.005
#: Texts, and elements of their multisets, of a block that is compared with another one in a task.
BLOCK, BLOCK_ELEMENTS = 256, 1 << 19
#: Elements that are counted at a time when blocks are compared.
COUNTED = 1 << 14
#: Stands for a null id in joins; texts are joined by id and hash, so it may be an id as well.
_NO_ID = -(1 << 63)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class _Words(dict):
    """64-bit hash of each word; starts anew when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASH = _Words()


def shingle_counts(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, shingle hash and count of every distinct shingle. Fewer words than that are one shingle; no words, none."""
    docs, hashes = [], []
    factors = _mix(np.arange(1, words + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    get = _HASH.__getitem__
    for i, text in enumerate(texts):
        own = np.array(list(map(get, text.lower().split())), np.uint64)
        if not len(own):
            continue
        width = min(words, len(own))
        n = len(own) - width + 1
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total += own[k : k + n] * factors[k]
        hashes.append(_mix(total + np.uint64(width)))
        docs.append(np.full(n, i))
    if not docs:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[new], h[new], np.diff(np.r_[new, len(doc)])


def bag_minhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, components: int = COMPONENTS) -> np.ndarray:
    """Signatures (docs x components, unsigned 64-bit; the earliest point's time as bits) of weighted sets."""
    best = np.full(docs * components, np.inf)
    total = np.bincount(doc, count, docs)
    # One process for each dyadic level of weights that a shingle's count reaches into.
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(int), 0)
    who = np.repeat(np.arange(len(doc)), levels + 1)
    level = np.arange(len(who)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    floor = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, floor)
    seed = _mix(h[who] + (level.astype(np.uint64) + np.uint64(1)) * _GOLD)
    owner, most = doc[who], count[who]
    time, tick = np.zeros(len(who)), np.zeros(len(who), np.uint64)
    pending = np.zeros(len(who))
    # Times up to which points are wanted: enough to fill all components but once in a while; then twice that.
    until = np.where(total > 0, (np.log(components) + 3) / np.maximum(total, 1), 0)
    active = np.arange(len(who))
    while len(active):
        go = active
        while len(go):
            fresh = pending[go] == 0  # else the next point is known and was too late so far
            draw = go[fresh]
            tick[draw] += np.uint64(3)
            pending[draw] = time[draw] - np.log(_unit(_mix(seed[draw] + tick[draw] * _GOLD))) / (components * width[draw])
            go = go[pending[go] <= until[owner[go]]]
            time[go] = pending[go]
            pending[go] = 0
            low = floor[go] + width[go] * _unit(_mix(seed[go] + (tick[go] + np.uint64(1)) * _GOLD))
            seen = np.ceil(low) <= most[go]
            hit = go[seen]
            slot = (_mix(seed[hit] + (tick[hit] + np.uint64(2)) * _GOLD) % np.uint64(components)).astype(int)
            np.minimum.at(best, owner[hit] * components + slot, time[hit])
        short = np.isinf(best.reshape(docs, components)).any(axis=1) & (total > 0)
        until = np.where(short, until * 2, 0)
        active = np.flatnonzero(short[owner])
    return best.view(np.uint64).reshape(docs, components)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """docs x BANDS signed 64-bit keys."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[:, b] = _mix(keys[:, b] * np.uint64(31) + signature[:, b * ROWS + r] + np.uint64(b + 1))
    return keys.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """docs x COMPONENTS / 8 signed 64-bit numbers: a byte for each component."""
    return np.ascontiguousarray((_mix(signature) & np.uint64(255)).astype(np.uint8)).view(np.int64)


def _agreement(a: Column, b: Column) -> Column:
    """How many bytes of two sketches are equal."""
    differ = F.lit(0)
    for i in range(COMPONENTS // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for half in (4, 2, 1):  # the lowest bit of a byte becomes whether any of its bits is set
            x = x.bitwiseOR(F.shiftrightunsigned(x, half))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(COMPONENTS) - differ


def least_agreement(similarity: float) -> int:
    """Agreement that a pair of ``similarity`` reaches but for a chance of MARGIN standard deviations."""
    p = similarity + (1 - similarity) / 256
    return int(COMPONENTS * p - MARGIN * (COMPONENTS * p * (1 - p)) ** 0.5)


def text_digest(text: str) -> bytes | None:
    """128 bits of the text's words; None without any."""
    own = text.lower().split()
    return hashlib.sha256(" ".join(own).encode("utf-8", "surrogatepass")).digest()[:16] if own else None


def _slices(batch: pd.DataFrame, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch of bounded text, so that memory doesn't follow the batch; a longer text is a part of its own."""
    sizes = batch["text"].str.len().to_numpy().cumsum() // chars
    for _, part in batch.groupby(sizes, sort=False):
        yield part


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in _slices(batch):
            texts = part["text"].tolist()
            doc, h, count = shingle_counts(texts)
            signature = bag_minhash(doc, h, count, len(part))
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].astype("Int64"),
                    "text_key": part["text_key"].to_numpy(),
                    "digest": [text_digest(t) for t in texts],
                    "weight": np.bincount(doc, count, len(part)).astype(np.int64),
                    "keys": list(band_keys(signature)),
                    "sketch": list(sketches(signature)),
                }
            )


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The multiset as a set: one hash for each shingle and occurrence. Texts other than the node's own are passed over."""
    for batch in batches:
        batch = batch[[text_digest(t) == d for t, d in zip(batch["text"], batch["digest"], strict=True)]]
        for part in _slices(batch) if len(batch) else ():
            doc, h, count = shingle_counts(part["text"].tolist())
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            each = _mix(np.repeat(h, count) + nth.astype(np.uint64) * _GOLD).view(np.int64)
            cuts = np.cumsum(np.bincount(doc, count, len(part)).astype(int))[:-1]
            yield pd.DataFrame({"node": part["node"].to_numpy(), "elements": np.split(each, cuts)})


def connected(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """id and root (the smallest id of its component) of every id in ``links`` (a, b), by alternating large and small stars."""
    edges = space.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}_0")
    step, mark = 0, None
    while True:
        before, mark = mark, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return space.table(edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), f"{name}_roots")
        # large star: larger neighbours go to the smallest neighbour
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges = space.table(small, f"{name}_{step}")
        space.drop(f"{name}_{step - 1}")


def _central_pairs(crowd: DataFrame) -> DataFrame:
    """(a, b, wa, wb) of each bucket's member and the one that has the most company over all its buckets."""
    score = crowd.groupBy("node").agg(F.sum("n").alias("score"))
    best = F.max_by(F.struct("node", "weight"), F.struct("score", -F.col("node")))
    hubs = crowd.join(score, "node").groupBy("bucket").agg(best.alias("hub")).select("bucket", F.col("hub.node").alias("b"), F.col("hub.weight").alias("wb"))
    return crowd.join(hubs, "bucket").where("node <> b").select(F.col("node").alias("a"), "b", F.col("weight").alias("wa"), "wb")


def _class_pairs(live: DataFrame, turn: int) -> DataFrame:
    """(a, b, wa, wb) of different classes: all of a small bucket, in a larger one HUBS members and a representative of each other class."""
    small = live.where(F.col("n") <= SMALL)
    hubs = small.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("weight").alias("wb"))
    pairs = small.join(hubs, "bucket").where("node < b and root <> rb")
    large = live.where(F.col("n") > SMALL)
    drawn = large.select("*", F.explode(F.array(*map(F.lit, range(HUBS)))).alias("k"))
    some = drawn.groupBy("bucket", "k").agg(F.max_by(F.struct("node", "root", "weight"), F.xxhash64("node", "bucket", "k", F.lit(turn))).alias("hub")).select("bucket", F.col("hub.node").alias("b"), F.col("hub.root").alias("rb"), F.col("hub.weight").alias("wb"))
    each = large.groupBy("bucket", "root").agg(F.max_by(F.struct("node", "weight"), F.xxhash64("node", "bucket", F.lit(-turn))).alias("it")).select("bucket", "root", "it.node", "it.weight")
    return pairs.select(F.col("node").alias("a"), "b", F.col("weight").alias("wa"), "wb").union(each.join(some, "bucket").where("root <> rb").select(F.col("node").alias("a"), "b", F.col("weight").alias("wa"), "wb"))


class _Verifier:
    """Finds those of proposed pairs whose weighted Jaccard similarity reaches the bound; no pair is tried twice."""

    def __init__(self, space: Workspace, nodes: DataFrame, members: DataFrame, texts: DataFrame, similarity: float):
        self.space, self.similarity, self.tried, self.turn = space, similarity, None, 0
        held = space.table(nodes.join(members, "node", "left_semi").select("node", "digest", "ident", "text_key", "sketch"), "members")
        self.sketch = held.select("node", "sketch")
        wanted = held.select("node", "digest", "ident", "text_key")
        # both sides grow with the corpus, so neither is broadcast
        sets = texts.join(wanted.hint("merge"), ["ident", "text_key"]).select("node", "digest", "text").mapInPandas(_elements, "node long, elements array<long>")
        self.sets = space.table(sets, "sets")
        if self.sets.count() > held.count():  # only if rows repeat an id and its text
            self.sets = space.table(self.sets.dropDuplicates(["node"]), "sets_once")

    def links(self, pairs: DataFrame) -> DataFrame:
        t = self.similarity
        near = pairs.where(F.least("wa", "wb") >= t * F.greatest("wa", "wb"))
        pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = self.space.table(pairs, f"pairs_{self.turn}")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        side = lambda table, column, p: table.select(F.col("node").alias(p), F.col(column).alias(f"x{p}"))
        alike = pairs.join(side(self.sketch, "sketch", "a"), "a").join(side(self.sketch, "sketch", "b"), "b").where(_agreement(F.col("xa"), F.col("xb")) >= least_agreement(t)).select("a", "b")
        alike = self.space.table(alike, f"alike_{self.turn}")
        both = alike.join(side(self.sets, "elements", "a"), "a").join(side(self.sets, "elements", "b"), "b")
        common = F.size(F.array_intersect("xa", "xb"))
        links = both.where(common >= t * (F.size("xa") + F.size("xb") - common)).select("a", "b")
        links = self.space.table(links, f"links_{self.turn}")
        self.turn += 1
        return links


def _blocks(live: DataFrame, verifier: _Verifier, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Blocks of the texts of buckets of several classes, and the pairs of blocks that hold a candidate.

    A text stands with its class, if that is large, or else with the largest of
    its buckets. Pairs of blocks have members in a common bucket, and more than
    one class between them.
    """
    sizes = live.select("node", "root").distinct().groupBy("root").agg(F.count("*").alias("size"))
    largest = live.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("most"), F.first("root").alias("root"), F.first("weight").alias("weight"))
    homed = largest.join(sizes, "root").withColumn("home", F.when(F.col("size") > SMALL, F.xxhash64("root", F.lit(1))).otherwise(F.col("most.bucket")))
    parts = homed.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("weight") / BLOCK_ELEMENTS)).alias("parts"))
    placed = homed.join(parts, "home").select("node", "root", "weight", F.xxhash64("home", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))).alias("block"))
    placed = space.table(placed, "placed_in_blocks")
    pure = placed.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    at = live.select("bucket", "node").join(placed.select("node", "block"), "node").select("bucket", "block").distinct()
    pairs = at.withColumnRenamed("block", "i").join(at.withColumnRenamed("block", "j"), "bucket").where("i <= j").select("i", "j").distinct()
    side = lambda c: pure.select(F.col("block").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"))
    pairs = pairs.join(side("i"), "i").join(side("j"), "j").where("low_i <> high_i or low_j <> high_j or low_i <> low_j").select("i", "j")
    own = placed.join(verifier.sketch, "node").join(verifier.sets, "node")
    held = F.array_sort(F.collect_list(F.struct("node", "root", "weight", "sketch", "elements")))
    blocks = own.groupBy("block").agg(held.alias("m")).select("block", *(F.col(f"m.{c}").alias(f"{c}s") for c in ("node", "root", "weight")), F.flatten("m.sketch").alias("sketches"), F.flatten("m.elements").alias("elements"))
    return space.table(blocks, "blocks"), space.table(pairs, "block_pairs")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``, counted by COUNTED elements at a time."""
    lengths = [len(x) for x in (*a, *b)]
    every, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(every), COUNTED):
        lo, hi = np.searchsorted(place, [at, at + COUNTED])
        has = np.zeros((len(lengths), min(COUNTED, len(every) - at)), np.float32)
        has[owner[lo:hi], place[lo:hi] - at] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out.astype(np.int64)


def block_links(one: dict, two: dict, similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different classes of two blocks: for each text and other class, one if there is any."""
    sketch = [np.ascontiguousarray(x["sketches"], np.int64).view(np.uint8).reshape(-1, COMPONENTS) for x in (one, two)]
    weight = [np.asarray(x["weights"], np.int64) for x in (one, two)]
    low, high = np.minimum.outer(*weight), np.maximum.outer(*weight)
    open_ = (low >= similarity * high) & np.not_equal.outer(one["roots"], two["roots"])
    for i in np.flatnonzero(open_.any(axis=1)):
        open_[i] &= (sketch[1] == sketch[0][i]).sum(axis=1) >= least_agreement(similarity)
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return []
    cut = [np.split(x["elements"], np.cumsum(w)[:-1]) for x, w in zip((one, two), weight, strict=True)]
    common = overlaps([cut[0][i] for i in rows], [cut[1][j] for j in cols])
    union = weight[0][rows][:, None] + weight[1][cols] - common
    found = open_[np.ix_(rows, cols)] & (common >= similarity * union)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(found), strict=True):
        a, b = int(one["nodes"][rows[i]]), int(two["nodes"][cols[j]])
        best.setdefault((a, int(two["roots"][cols[j]])), (a, b))
        best.setdefault((b, int(one["roots"][rows[i]])), (a, b))
    return sorted({(min(x), max(x)) for x in best.values()})


def _rest(live: DataFrame, verifier: _Verifier, space: Workspace) -> DataFrame:
    """(a, b) of links between classes that share a bucket: at least one for each text and other class that have any."""
    blocks, pairs = _blocks(live, verifier, space)

    def compare(table: pa.Table) -> pa.Table:
        names = ("nodes", "roots", "weights", "sketches", "elements")
        rows = [{c: table[c][k].values.to_numpy(zero_copy_only=False) for c in names} for k in range(table.num_rows)]
        links = block_links(rows[0], rows[-1], similarity)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    similarity = verifier.similarity
    # a pair's blocks meet in one group, each block once, and groups are spread by pairs
    ends = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    met = ends.join(blocks, "block").groupBy("i", "j").applyInArrow(lambda t: compare(t.select(["nodes", "roots", "weights", "sketches", "elements"])), "a long, b long")
    return space.table(met.distinct(), "rest")


def _roots(nodes: DataFrame, texts: DataFrame, similarity: float, space: Workspace) -> DataFrame:
    """id (a node) and root of all nodes that have a link."""
    banded = nodes.select("node", "weight", F.posexplode("keys").alias("band", "key")).select("node", "weight", F.xxhash64("band", "key").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowd = space.table(banded.join(shared, "bucket"), "crowd")
    verifier = _Verifier(space, nodes, crowd.select("node").distinct(), texts, similarity)
    roots = connected(verifier.links(_central_pairs(crowd)), space, "roots_0")

    def several(roots: DataFrame, crowd: DataFrame, name: str) -> DataFrame:
        """Members of buckets with more than one class; classes only grow, so a bucket of one is done with."""
        live = crowd.join(roots.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", "weight", "n", F.coalesce("root", "node").alias("root"))
        mixed = live.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        return space.table(live.join(mixed, "bucket", "left_semi"), name)

    def joined(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
        of = lambda p: roots.select(F.col("id").alias(p), F.col("root").alias(f"r{p}"))
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        moved = connected(between, space, f"moved_{name}").select(F.col("id").alias("root"), F.col("root").alias("to"))
        fresh = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().join(roots.select("id"), "id", "left_anti")
        ids = roots.select("id", "root").unionByName(fresh.select("id", F.col("id").alias("root")))
        return space.table(ids.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")), f"roots_{name}")

    turn = 0
    while True:
        turn += 1
        live = several(roots, crowd, f"live_{turn}")
        links = verifier.links(_class_pairs(live, turn))
        found = links.count()
        if found:
            roots = joined(roots, links, str(turn))
            crowd = live.select("bucket", "node", "weight", "n")
        if found < max(1, WORTH * live.select("node").distinct().count()):
            break
    left = _rest(several(roots, crowd, "live_rest"), verifier, space)
    return joined(roots, left, "rest") if left.count() else roots


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells a text of an id from its other texts."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, copy_of, kept and text_key (hash of the text).

    Classes are the connected components of rows whose multisets of five-word
    shingles (lower case, separated by white space; fewer words make one
    shingle) have a weighted Jaccard similarity of ``similarity`` or more.
    ``class_id`` is the smallest id of the class, ``class_size`` its rows.
    ``copy_of`` is the smallest id with the same words. One row of each class is
    ``kept``: that of the smallest id and, where it has several texts, of the
    smallest digest. Null texts and texts without words are equal to nothing:
    each is a class of its own. Rows that share an id are told apart by their
    texts. A null id comes after all others; a class without any id has a null
    ``class_id``. Other columns are not read; an empty table gives no rows.

    Texts of a bucket that rounds leave in different classes are all compared,
    so classes don't depend on the rounds, nor on partitions. No text of a pair
    of exactly 0.8 shares a bucket with the other with probability 3e-6, and
    sketches rule such a pair out with about 1e-6.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    ident, key = _keyed(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One pass over the texts; copies are signed too, which costs less than moving texts to fold them first.
    every = rows.mapInPandas(_signed, "doc_id long, text_key long, digest binary, weight long, keys array<long>, sketch array<long>")
    every = space.table(every.withColumn("row", F.monotonically_increasing_id()), "signed")
    last = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"))  # orders null ids after the others
    nodes = every.where("digest is not null").groupBy("digest").agg(F.min(F.struct(last.alias("id"), "text_key")).alias("first"), F.first(F.struct("weight", "keys", "sketch")).alias("s"))
    nodes = nodes.select("digest", F.col("first.id.doc_id").alias("copy_of"), F.coalesce("first.id.doc_id", F.lit(_NO_ID)).alias("ident"), "first.text_key", "s.*").withColumn("node", F.monotonically_increasing_id())
    nodes = space.table(nodes, "nodes")
    texts = docs.select(ident.alias("ident"), key.alias("text_key"), F.col(text_col).alias("text"))
    roots = _roots(nodes, texts, similarity, space)
    of_text = nodes.select("node", "digest", "copy_of").join(roots.withColumnRenamed("id", "node"), "node", "left").select("digest", "copy_of", F.coalesce("root", "node").alias("root"))
    placed = every.where("digest is not null").select("doc_id", "text_key", "digest", "row").join(of_text, "digest")
    placed = space.table(placed, "placed")
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(last.alias("id"), "digest", "row")).alias("best"))
    named = placed.join(classes, "root").select("doc_id", "class_id", "class_size", "copy_of", (F.col("row") == F.col("best.row")).alias("kept"), "text_key")
    one = F.lit(1).cast("long").alias("class_size")
    return named.unionByName(every.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), one, F.col("doc_id").alias("copy_of"), F.lit(True).alias("kept"), "text_key"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The row of ``docs`` that is kept of each class of ``near_duplicates``, with all columns.

    Rows are told apart by id and text. Of rows that repeat both, one stays if
    theirs is the text that is kept, whichever it is by other columns; texts
    without words all stay. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession)
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    keys = found.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__nd_id"), F.col("text_key").alias("__nd_key")).agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    odd = space.table(keys.where("kept < n").select("__nd_id", "__nd_key", (F.col("kept") > 0).alias("__nd_once")), "odd")
    ident, key = _keyed(docs, id_col, text_col)
    rows = docs.withColumns({"__nd_id": ident, "__nd_key": key})
    on = ["__nd_id", "__nd_key"]
    once = rows.join(odd.where("__nd_once").select(*on), on, "left_semi").dropDuplicates(on)
    return rows.join(odd.select(*on), on, "left_anti").unionByName(once).select(*docs.columns)
