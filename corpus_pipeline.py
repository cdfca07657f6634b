"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandscope.llm import decontaminate, line_dedup, near_dedup, packing, toxicity, workspace
from strandscope.llm.queries import table, vocabulary


def _shielded(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """``operator``'s result on ``docs``, whose columns but doc_id and text have names that no result of it has, and their own names by those."""
    held = {f"__in_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return operator(docs.withColumnsRenamed({c: h for h, c in held.items()})), held


def _restored(rows: DataFrame, docs: DataFrame, held: dict[str, str]) -> DataFrame:
    return rows.withColumnsRenamed({h: f"__out_{h}" for h in held}).select("doc_id", "text", *(F.col(f"__out_{h}").alias(c) for h, c in held.items())).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below one half.

    Null and empty texts stay. Every row is judged by its own text, whatever ids
    repeat or are null. Without labels nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored, held = _shielded(docs, lambda d: toxicity.score_documents(d, model))
    return _restored(scored.where(~F.col("rejected")), docs, held)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages seen before, n_chars following the text; those of which nothing is left go.

    Null and empty texts stay. Of equal passages the first by doc_id stays, a
    null id being first; rows that share an id are told apart by their texts,
    and rows that repeat both keep and lose the same lines.
    """
    out, held = _shielded(docs, lambda d: line_dedup.dedup_lines(d, short_words=50))
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.trim(F.col("text")) != ""))
    for h, c in held.items():
        if c == "n_chars":
            out = out.withColumn(h, F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(h)))
    return _restored(out, docs, held)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id.

    Null texts and texts without words stay. Rows are told apart by id and
    text; of rows that repeat both, one stays. Null ids come last.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.

    Null and empty texts and rows without an id stay. Of rows that share an id,
    those go in whose own text an item was found.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of 2048 tokens.

    A null or empty text is one piece of its end token. Repeated rows are packed
    each; an empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary(), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The fitted classifier, the signatures and the tokenizer have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over ``documents``. What a stage wrote for itself is deleted when the next one has read its result."""
    space = workspace.Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        mark = workspace.opened()
        docs = space.table(stage(spark, docs, sf_dir), name)
        workspace.purge(mark)
        if n:
            space.drop(STAGES[n - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
