"""Shared-storage scratch tables that cut lineage between the steps of an operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list["Workspace"] = []


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where there is none, a local session gets a temporary one; a cluster's is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
    root = "file://" + tempfile.mkdtemp(prefix="strandscope-")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Workspace:
    """A folder of parquet tables below the session's checkpoint folder.

    Tables survive the loss of executors, unlike cached or locally
    checkpointed blocks. Results of an operator read them lazily, so the
    folder is removed by ``purge`` once the results have been written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/strandscope-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written table."""
        target = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def opened() -> int:
    """How many workspaces are open, as a mark for ``purge``."""
    return len(_OPEN)


def purge(since: int = 0) -> None:
    """Delete the workspaces opened since a mark. Call it when no result that reads one is still needed."""
    while len(_OPEN) > since:
        _OPEN.pop().drop()


def passed_through(df: DataFrame, *results: str) -> list[str]:
    """Columns of ``df`` that an operator hands on: all but those that a result column replaces."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]
