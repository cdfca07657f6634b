"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its documents into a sorted run of (digest, smallest id,
count). Runs are then exchanged in binomial rounds: partitions are numbered in
base ``fan_in``; in round r the ``fan_in`` partitions whose numbers differ only
in digit r exchange runs, each keeping the digests that have its digit there,
and merge what they received. After the last round each digest has been merged
over all partitions, and no partition has held more than its share of digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

SPACES = "[\\x20\\x09-\\x0D]+"
KEY = ["digest", "length", "check"]
_RUN = "node int, digest binary, length long, check long, min_id long, n long"


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows sorted by (node, digest, length, check) into one row each: smallest id, sum of counts.

    Two rows count as the same text only if digest, length and second hash all
    agree; this is verified again at every level of the tree.
    """
    held = None
    schema = None
    for batch in batches:
        schema = batch.schema
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        cols = [table[c].combine_chunks() for c in ("node", *KEY)]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        ids = pc.fill_null(table["min_id"], np.iinfo(np.int64).max).to_numpy()
        ids = np.minimum.reduceat(ids, at)
        out = table.take(pa.array(at))
        out = out.set_column(4, "min_id", pa.array(ids, mask=ids == np.iinfo(np.int64).max))
        out = out.set_column(5, "n", pa.array(np.add.reduceat(table["n"].to_numpy(), at)))
        held = out.slice(out.num_rows - 1).cast(schema)
        yield from out.slice(0, out.num_rows - 1).cast(schema).to_batches()
    if held is not None:
        yield from held.to_batches()


def _merged(runs: DataFrame) -> DataFrame:
    return runs.sortWithinPartitions("node", *KEY, "min_id").mapInArrow(merge_runs, _RUN)


def digest_groups(keyed: DataFrame, *, fan_in: int = 16) -> DataFrame:
    """``keyed`` (doc_id, digest, length, check) to one row a text: digest, length, check, keep_id, group_size."""
    rounds, parts = 1, keyed.rdd.getNumPartitions()
    while fan_in**rounds < parts and rounds < 5:
        rounds += 1
    runs = keyed.select(F.pmod(F.spark_partition_id(), F.lit(fan_in**rounds)).alias("node"), *KEY, F.col("doc_id").alias("min_id"), F.lit(1).cast("long").alias("n"))
    runs = _merged(runs)  # each partition's own sorted run; a frequent text is one row from here on
    place = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    for r in range(rounds):
        unit = fan_in**r
        digit = lambda c: F.pmod(F.floor(c / unit), F.lit(fan_in))  # noqa: B023, E731
        runs = runs.withColumn("node", (F.col("node") + (digit(place) - digit(F.col("node"))) * unit).cast("int"))
        runs = _merged(runs.repartition("node"))
    return runs.select(*KEY, F.col("min_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space is
    replaced by one space; null counts as empty. The smallest id of equal texts
    stays. Rows that repeat an id are one document: each counts in group_size,
    and all of them are marked kept if that id stays. Rows without an id are
    kept only if the whole group has none. An empty table gives no rows; other
    columns are not read.
    """
    space = Workspace(docs.sparkSession)
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = keyed.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("length"), F.xxhash64("text").alias("check"))
    keyed = space.table(keyed, "keyed")
    groups = digest_groups(keyed, fan_in=fan_in)
    return keyed.join(groups, KEY).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
