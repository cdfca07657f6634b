"""Checks before a run and of its output: inputs that exist, folders that only their owner can read."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shortest capture file: a header without packets.
SMALLEST = 24


def local_path(path: str) -> str | None:
    """The path on this machine; None for a path on another store, whose permissions are the store's."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path or path.startswith("hdfs:") else path


def claim(output: str) -> list[str]:
    """Make a private folder for a run's output, and say what speaks against one that is there."""
    path = local_path(output)
    if path is None:
        return []
    if not os.path.lexists(path):
        os.makedirs(path, mode=0o700)
    return exposed(output)


def exposed(output: str) -> list[str]:
    """Why others could read or replace an output: links, access by others, other owners. The folder's own mode guards what is in it."""
    path = local_path(output)
    if path is None:
        return []
    if os.path.islink(path):
        return [f"link:{path}"]
    if not os.path.isdir(path):
        return [f"not_a_folder:{path}"]
    held = os.stat(path)
    found = [f"readable_by_others:{path}"] if stat.S_IMODE(held.st_mode) & 0o077 else []
    found += [f"other_owner:{path}"] if held.st_uid != os.geteuid() else []
    for folder, folders, files in os.walk(path):
        for name in (*folders, *files):
            at = os.path.join(folder, name)
            if os.path.islink(at):
                found.append(f"link:{at}")
            elif name in files and os.stat(at).st_nlink > 1:
                found.append(f"hard_link:{at}")
    return found


def unreadable(spark: SparkSession, captures: str) -> DataFrame:
    """path and length of inputs that can't hold a capture. Only names and sizes are looked up, no content is read."""
    return spark.read.format("binaryFile").load(captures).select("path", "length").where(F.col("length") < SMALLEST)
