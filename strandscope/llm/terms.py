"""Terms of texts: maximal runs of ASCII letters and digits and of characters beyond ASCII, with only A-Z in lower case."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of UTF-8: separators become spaces, A-Z become a-z, the rest stays, so offsets stay too.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(term: str) -> str:
    return term.translate(_LOWER)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts have at most ``most`` bytes, or are a single text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Place of its text, and the term, for every term in order; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    own = bytes(data.slice(offsets[0], offsets[-1] - offsets[0])) if data else b""
    folded = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(own.translate(_FOLD))])
    lists = pc.ascii_split_whitespace(folded)
    rows, found = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(found), 0)
    return rows.filter(full).to_numpy(), found.filter(full)
