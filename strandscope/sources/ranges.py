"""Long capture files in byte ranges, each read by a task, with the rows of a whole read.

Records can't be told from the middle of a file for certain. So every range
first looks for a chain of records that agree, and walks it to the first record
beyond the range. Where a range's walk ends has to be where the next one's
began: then, from the file's header on, all of them are the file's own records.
A range that began elsewhere, as when a packet holds records itself, is walked
again from where the one before it ended. The walks count packets, so ids are
those of a whole read, and carry the interfaces of PCAPNG files along.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import capture
from .capture import CaptureError, CaptureFilter, Classic, Section

#: Blocks that have to agree before a place counts as a beginning.
AGREE = 4


def opened(path: str) -> BinaryIO:
    """A file by path or URI: local ones, and those of stores that Arrow reads."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" not in plain:
        return open(plain, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


@dataclass
class Walk:
    """Records of a range: where the first one is, where the first one beyond it is, how many packets, and what broke it.

    ``links`` are interfaces met in it, ``fresh`` whether they are of a section
    that began in it; ``needs`` is how many interfaces from before its packets
    ask for.
    """

    first: int | None
    stop: int
    packets: int = 0
    error: str | None = None
    order: str = "<"
    links: list = field(default_factory=list)
    fresh: bool = False
    needs: int = 0
    forced: bool = False  # walked again from where the range before it ended


def _classic_walk(stream: BinaryIO, head: Classic, first: int, stop: int, length: int) -> Walk:
    out = Walk(first, first)
    stream.seek(first)
    held, base = b"", first
    at = first
    while at < stop and at < length:
        if at + 16 > base + len(held):
            stream.seek(at)
            base, held = at, stream.read(1 << 20)
        if at + 16 > base + len(held):
            return Walk(first, at, out.packets, "truncated_record_header")
        try:
            _, captured, _ = head.check(held, at - base)
        except CaptureError as problem:
            return Walk(first, at, out.packets, str(problem))
        if at + 16 + captured > length:
            return Walk(first, at, out.packets, "truncated_record")
        out.packets += 1
        at += 16 + captured
    out.stop = at
    return out


def _classic_start(stream: BinaryIO, head: Classic, start: int, stop: int, length: int) -> int | None:
    """The first place from ``start`` on from which records follow each other for longer than any packet is, or to the file's end."""
    reach = head.snaplen + 32
    step = max(1 << 16, min(reach, 1 << 20))
    at = start
    while at < stop:
        stream.seek(at)
        data = stream.read(step + 2 * reach)
        if len(data) < 16:
            return None
        count = min(step, len(data) - 15)
        whole = np.frombuffer(data, np.uint8)
        number = lambda k: np.lib.stride_tricks.sliding_window_view(whole[k : k + count + 3], 4).copy().view(head.order + "u4")[:, 0]  # noqa: B023, E731
        fits = (number(4) < 1_000_000_000 // head.unit) & (number(8) <= head.snaplen) & (number(12) >= number(8))
        for o in np.flatnonzero(fits).tolist():
            here = o
            while here - o <= reach and here + 16 <= len(data):
                try:
                    here += 16 + head.check(data, here)[1]
                except CaptureError:
                    break
            else:
                if here - o > reach or at + here == length:
                    return at + o if at + o < stop else None
        at += count
    return None


def _block_walk(stream: BinaryIO, section: Section, known: bool, first: int, stop: int) -> Walk:
    """``known``: the section's interfaces are all there, so packets can be checked against them."""
    out = Walk(first, first, order=section.order)
    before = len(section.links) if known else 0
    stream.seek(first)
    try:
        for kind, length, body in capture.blocks(stream, section, stop - first):
            if kind == capture.SECTION:
                known, before, out.fresh = True, 0, True
            if kind == capture.PACKET_ENHANCED and not known:
                if len(body) < 20:
                    raise CaptureError("invalid_packet_block")
                number, _, _, captured, wire = struct.unpack_from(section.order + "IIIII", body)
                if captured > len(body) - 20 or wire < captured:
                    raise CaptureError("invalid_packet_block")
                out.needs = max(out.needs, number + 1 - len(section.links))
                out.packets += 1
            elif kind == capture.PACKET_SIMPLE and not known:
                if len(body) < 4:
                    raise CaptureError("invalid_packet_block")
                out.needs = max(out.needs, 1)
                out.packets += 1
            elif section.packet(kind, body):
                out.packets += 1
            out.stop += length
    except CaptureError as problem:
        out.error = str(problem)
    out.links, out.order = section.links[before:], section.order
    return out


def _block_start(stream: BinaryIO, order: str, start: int, stop: int, length: int) -> int | None:
    """The first place from ``start`` on, at a multiple of 4, at which some blocks follow each other with lengths at both ends that agree."""
    at = -(-start // 4) * 4
    while at < stop:
        stream.seek(at)
        data = stream.read((1 << 20) + (1 << 18))
        numbers = np.frombuffer(data[: len(data) // 4 * 4], order + "u4")
        sizes = numbers[1:]
        fits = (sizes >= 12) & (sizes % 4 == 0) & (sizes <= capture.MAX_BLOCK)
        for o in (np.flatnonzero(fits[: (1 << 20) // 4]) * 4).tolist():
            here, agreed = o, 0
            while agreed < AGREE and here + 12 <= len(data):
                size = int(struct.unpack_from(order + "I", data, here + 4)[0])
                end = here + size
                if size < 12 or size % 4 or size > capture.MAX_BLOCK or at + end > length:
                    break
                if end > len(data):
                    stream.seek(at + end - 4)
                    same = stream.read(4) == data[here + 4 : here + 8]
                else:
                    same = data[end - 4 : end] == data[here + 4 : here + 8]
                if not same:
                    break
                here, agreed = end, agreed + 1
            if agreed == AGREE or (agreed and at + here == length):
                return at + o if at + o < stop else None
        at += 1 << 20
    return None


def walk(path: str, start: int, stop: int, length: int, forced: dict | None = None) -> Walk:
    """Walk a range of a file, from its header if it begins there, from ``forced`` (first, order, links) or from the first records that agree."""
    with opened(path) as stream:
        magic = stream.read(4)
        try:
            if magic in capture.CLASSIC:
                head = capture.classic_header(stream, magic)
                first = forced["first"] if forced else 24 if start == 0 else _classic_start(stream, head, max(24, start), stop, length)
                return Walk(None, stop) if first is None else _classic_walk(stream, head, first, stop, length)
            if magic != capture.SECTION_MARK:
                raise CaptureError("unknown_capture_format")
            if forced or start == 0:
                given = forced or {"first": 0, "order": "<", "links": []}
                return _block_walk(stream, Section(given["order"], [tuple(x) for x in given["links"]]), True, given["first"], stop)
            stream.seek(8)
            order = ">" if stream.read(4) == b"\x1a\x2b\x3c\x4d" else "<"
            first = _block_start(stream, order, start, stop, length)
            return Walk(None, stop) if first is None else _block_walk(stream, Section(order), False, first, stop)
        except CaptureError as problem:
            return Walk(start, start, error=str(problem))


_RANGE = "file int, path string, k long, start long, stop long, length long, forced string"


def _walked(spark: SparkSession, rows: list[tuple]) -> dict[tuple[int, int], Walk]:
    """Walks of ranges (_RANGE) by file and number, made by Spark's tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                w = walk(r.path, int(r.start), int(r.stop), int(r.length), json.loads(r.forced) if r.forced else None)
                yield pd.DataFrame([(r.file, r.k, json.dumps(w.__dict__))], columns=["file", "k", "walk"])

    done = spark.createDataFrame(rows, _RANGE).repartition(len(rows), "file", "k").mapInPandas(run, "file int, k long, walk string")
    return {(r["file"], r["k"]): Walk(**json.loads(r["walk"])) for r in done.toLocalIterator()}


def plan(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int) -> list[dict]:
    """Ranges of the files that begin and end with records of their own: path, first, stop, number (packets before), order and links.

    A range is some hundred bytes here; there is one for each ``range_bytes``.
    """
    ranges = [(f, path, k, k * range_bytes, min(length, (k + 1) * range_bytes), length, None) for f, (path, length) in enumerate(files) for k in range(max(1, -(-length // range_bytes)))]
    walks = _walked(spark, ranges) if ranges else {}
    while True:
        out, again = [], []
        by_file: dict[int, list[tuple]] = {}
        for r in ranges:
            by_file.setdefault(r[0], []).append(r)
        for own in by_file.values():
            at, number, order, links = 0, 0, "<", []
            for f, path, k, start, stop, length, _ in own:
                w = walks[f, k]
                if k and at >= stop:
                    continue  # a record goes over the whole of it
                if k and (w.first != at or (w.needs and w.needs > len(links)) or (w.error and not w.fresh and w.error == "invalid_packet_block")) and not w.forced:
                    again.append((f, path, k, start, stop, length, json.dumps({"first": at, "order": order, "links": links})))
                    break
                out.append({"path": path, "first": w.first if k else 0, "stop": w.stop, "number": number, "order": order, "links": links, "broken": w.error is not None})
                if w.error:
                    break  # nothing behind it can be read
                links = list(w.links) if w.fresh else [*links, *w.links]
                at, number, order = w.stop, number + w.packets, w.order
        if not again:
            return out
        for key, w in _walked(spark, again).items():
            w.forced = True
            walks[key] = w


def read_ranges(spark: SparkSession, files: list[tuple[str, int]], kept: CaptureFilter = capture.ALL, *, range_bytes: int = 64 << 20) -> DataFrame:
    """Packets of ``files`` (path, length), each range read by a task; rows are those of a whole read. Files have to be readable by ``opened``."""
    planned = [(r["path"], r["first"], r["stop"], r["number"], r["order"], json.dumps(r["links"]), r["broken"]) for r in plan(spark, files, range_bytes)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with opened(r.path) as stream:
                    yield from capture._frames(filter(kept.keeps, capture.rows_of(stream, r.path, os.path.basename(r.path), _packets(stream, r), int(r.number))))

    ranges = spark.createDataFrame(planned, "path string, first long, stop long, number long, `order` string, links string, broken boolean")
    return ranges.repartition(max(1, len(planned)), "path", "first").mapInPandas(read, capture.SCHEMA)


def _packets(stream: BinaryIO, r) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Packets of a planned range; one that breaks is read on, to where it does."""
    size = None if r.broken else int(r.stop) - int(r.first)
    if not r.first:
        if r.broken:
            yield from capture.packets(stream)
            return
        magic = stream.read(4)
        if magic in capture.CLASSIC:
            yield from capture.classic_records(stream, capture.classic_header(stream, magic), size - 24)
            return
        stream.seek(0)
        yield from capture.block_records(stream, Section(), size)
        return
    magic = stream.read(4)
    if magic in capture.CLASSIC:
        head = capture.classic_header(stream, magic)
        stream.seek(int(r.first))
        yield from capture.classic_records(stream, head, size)
        return
    stream.seek(int(r.first))
    yield from capture.block_records(stream, Section(r.order, [tuple(x) for x in json.loads(r.links)]), size)
