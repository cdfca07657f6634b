"""Byte-balanced sharding by histogram sort, in DataFrame operations only.

Documents are ordered by (hash of the text, document id), so equal texts are
neighbours, and only a group that straddles a boundary and outweighs every
single document is divided. The
boundaries are found without sorting: every round counts the exact bytes below
a set of candidate boundaries over all partitions, and replaces the candidates
by finer ones inside the interval that holds each target, until the interval is
lighter than the tolerance. Rows are then exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace, passed_through

#: Bits of the 128-bit ordering key (64 of the text hash, 64 of the scaled id) that each round resolves.
LEVELS = (12, 12, 12, 12, 12, 4) * 2
_TOP = 1 << 63
_MASK = (1 << 64) - 1


def _signed(u: int) -> int:
    return u - _TOP


def _prefix(hash_key: Column, id_key: Column, bits: int) -> tuple[Column, Column]:
    """The leading bits of the key as two columns: of the hash, and of the id once the hash is used up."""
    flip = F.lit(-_TOP)
    if bits <= 64:
        return F.shiftrightunsigned(hash_key.bitwiseXOR(flip), 64 - bits), F.lit(0).cast("long")
    return hash_key.bitwiseXOR(flip), F.shiftrightunsigned(id_key.bitwiseXOR(flip), 128 - bits)


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Boundaries (integers below 2**128) of ``shards`` intervals of near-equal bytes.

    ``keys`` has ``hash_key``, ``id_key`` and ``size``. What reaches the driver
    in a round is at most 2**12 counts for each of the shards' boundaries,
    whatever the number of rows.
    """
    total, largest = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    slack = tolerance * total / shards
    active = {j: (0, 0) for j in range(1, shards)}  # boundary -> (prefix, bytes below it)
    found: dict[int, int] = {}
    bits = 0
    for step in LEVELS:
        if not active or not total:
            break
        wanted = sorted({p for p, _ in active.values()})
        rows = keys
        if bits:
            hi, lo = _prefix(F.col("hash_key"), F.col("id_key"), bits)
            keep = F.lit(False)
            for p in wanted:
                h, i = (p, 0) if bits <= 64 else (p >> (bits - 64), p & ((1 << (bits - 64)) - 1))
                h = h - (1 << 64) if h >= _TOP else h
                keep = keep | ((hi == F.lit(h)) & (lo == F.lit(i)))
            rows = rows.where(keep)
        bits += step
        hi, lo = _prefix(F.col("hash_key"), F.col("id_key"), bits)
        counts = rows.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        below: dict[int, list[tuple[int, int, int]]] = {}
        for r in counts:
            h = r["hi"] & _MASK
            cell = h if bits <= 64 else (h << (bits - 64)) | (r["lo"] & _MASK)
            below.setdefault(cell >> step, []).append((cell, r["bytes"], r["rows"]))
        nearer = {}
        for j, (p, base) in active.items():
            goal = total * j / shards
            cells = sorted(below[p])
            for n, (cell, size, held) in enumerate(cells):
                if base + size > goal or n == len(cells) - 1:
                    break
                base += size
            # a whole text hash is a group of equal texts: one that weighs no more than a document isn't divided
            if size <= slack or held == 1 or bits == 128 or (bits == 64 and size <= largest):
                found[j] = (cell + (goal - base > size / 2)) << (128 - bits)
            else:
                nearer[j] = (cell, base)
        active = nearer
    last = 0
    for j in range(1, shards):
        last = found[j] = max(last, found.get(j, 1 << 128))
    return [found[j] for j in range(1, shards)]


def _shard(hash_key: Column, id_key: Column, splitters: list[int]) -> Column:
    shard = F.lit(0)
    for b in splitters:
        if b < 1 << 128:
            h, i = F.lit(_signed(b >> 64)), F.lit(_signed(b & _MASK))
            shard = shard + ((hash_key > h) | ((hash_key == h) & (id_key >= i))).cast("int")
    return shard


def shard_documents(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, rows_per_cell: int = 50_000) -> DataFrame:
    """Add ``size`` (long), ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to all columns of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 8. A null text has no bytes and
    sorts with the empty one; a null id sorts as 0. Ties (repeated rows with
    the same id and text) stay in one shard and take slots in any order. An
    empty table gives an empty result. Input columns named like a result are
    replaced. Slots are numbered by cells (shard, leading hash bits, salt of
    the id), so that no text, however frequent, is numbered in a single task.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    keys = space.table(docs.select(F.xxhash64(text).alias("hash_key"), ident.alias("ident"), size.alias("size")), "keys")
    low, high, rows = keys.agg(F.min("ident"), F.max("ident"), F.count("*")).first()
    low, high = low or 0, high or 0
    shift = 64 - max(1, (high - low).bit_length())
    # ids that span more than 2**63 can't be shifted, nor need they be
    scaled = lambda c: F.shiftleft(c - F.lit(low), shift).bitwiseXOR(F.lit(-_TOP)) if shift else c
    keys = keys.withColumn("id_key", scaled(F.col("ident")))
    splitters = find_splitters(keys, shards, tolerance)
    salts = min(4096, max(8, -(-rows // (512 * rows_per_cell))))
    placed = [
        _shard(F.col("__ss_hash"), F.col("__ss_id"), splitters).alias("shard"),
        F.shiftrightunsigned(F.col("__ss_hash"), 55).cast("int").alias("__ss_cell"),
        F.pmod(F.xxhash64("__ss_id"), F.lit(salts)).cast("int").alias("__ss_salt"),
    ]
    cell = ["shard", "__ss_cell", "__ss_salt"]
    counts = keys.select(F.col("hash_key").alias("__ss_hash"), F.col("id_key").alias("__ss_id")).select(*placed).groupBy(*cell).agg(F.count("*").alias("n"))
    starts = counts.select(*cell, (F.sum("n").over(W.partitionBy("shard").orderBy("__ss_cell", "__ss_salt")) - F.col("n")).alias("__ss_start"))
    others = passed_through(docs, "size", "shard", "slot", "__ss_hash", "__ss_id", "__ss_cell", "__ss_salt", "__ss_start")
    dealt = docs.select(*others, size.alias("size"), F.xxhash64(text).alias("__ss_hash"), scaled(ident).alias("__ss_id")).select(*others, "size", "__ss_hash", "__ss_id", *placed)
    local = F.row_number().over(W.partitionBy(*cell).orderBy("__ss_hash", "__ss_id")) - 1
    return dealt.withColumn("__ss_local", local).join(starts, cell).select(*others, "size", "shard", (F.col("__ss_start") + F.col("__ss_local")).alias("slot"))
