"""CSV files with quoted line breaks, scanned in byte ranges.

A byte range can't tell by itself whether it begins inside a quoted cell. So
the scan takes two steps, both spread over the cluster:

1. Each range works out, for every state that it could begin in, the state that
   it ends in. A byte is a function of the states to the states; the functions
   of neighbouring bytes are composed pairwise by table look-up, in numpy, until
   one is left. Per file the functions of its ranges are then applied in turn,
   which gives each range its first state; this plan (a row per range) is
   written to the shared folder.
2. A Python data source makes a partition of each range (small files share
   one), which reads the records that begin inside it.

Compressed files can't be cut and are one range each.
"""

from __future__ import annotations

import csv
import io
import itertools
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ensure_checkpoint_dir, ship_package

FORMAT = "csv_ranges"
# States: at the start of a record, at the start of a cell, in a plain cell, in
# a quoted cell, behind a quote in a quoted cell.
RECORD, CELL, PLAIN, QUOTED, AFTER = range(5)
STEPS = {
    "quote": (QUOTED, QUOTED, PLAIN, AFTER, QUOTED),
    "comma": (CELL, CELL, CELL, QUOTED, CELL),
    "break": (RECORD, RECORD, RECORD, QUOTED, RECORD),
    "other": (PLAIN, PLAIN, PLAIN, QUOTED, PLAIN),
}
CLASSES = {ord('"'): "quote", ord(","): "comma", ord("\n"): "break"}
PIECE = 1 << 22
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
TO_THE_END = 1 << 62


def _functions() -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """All functions that compositions of the steps can give, the table of
    their compositions, and the function of each byte."""
    found = {tuple(range(5)): 0}
    for step in STEPS.values():
        found.setdefault(step, len(found))
    grown = True
    while grown:
        grown = False
        for f, g in list(itertools.product(found, found)):
            h = tuple(g[s] for s in f)  # f, then g
            if h not in found:
                found[h] = len(found)
                grown = True
    every = list(found)
    table = np.array([[found[tuple(g[s] for s in f)] for g in every] for f in every], dtype=np.uint8)
    of_byte = np.array([found[STEPS[CLASSES.get(b, "other")]] for b in range(256)], dtype=np.uint8)
    return every, table, of_byte


FUNCTIONS, COMPOSED, OF_BYTE = _functions()


def transition(piece: bytes) -> int:
    """Number of the function that the bytes are."""
    f = OF_BYTE[np.frombuffer(piece, dtype=np.uint8)]
    flat, width = COMPOSED.ravel(), np.uint16(len(FUNCTIONS))
    while len(f) > 1:
        if len(f) % 2:
            f = np.append(f, np.uint8(0))  # the identity
        f = flat[f[0::2] * width + f[1::2]]
    return int(f[0]) if len(f) else 0


def first_record(stream, at: int, state: int) -> int | None:
    """Place of the first record that begins at or behind ``at``, where the
    automaton is in ``state``; None if there is none."""
    while state != RECORD:
        piece = stream.read(PIECE)
        if not piece:
            return None
        for i, b in enumerate(piece):
            state = STEPS[CLASSES.get(b, "other")][state]
            if state == RECORD:
                return at + i + 1
        at += len(piece)
    return at


class _Lines:
    """Decoded lines of a stream; ``at`` is the place behind the last one."""

    def __init__(self, stream, at: int):
        self.stream, self.at = stream, at

    def __iter__(self):
        return self

    def __next__(self) -> str:
        line = self.stream.readline()
        if not line:
            raise StopIteration
        self.at += len(line)
        return line.decode("utf-8", errors="replace")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _stream(fs: pafs.FileSystem, path: str, at: int = 0):
    if path.endswith(COMPRESSED):
        return io.BufferedReader(fs.open_input_stream(path, compression="detect"), PIECE)
    raw = fs.open_input_file(path)
    raw.seek(at)
    return io.BufferedReader(raw, PIECE)


@dataclass
class Range:
    path: str
    start: int
    end: int
    state: int = RECORD
    header: tuple[str, ...] | None = None

    def records(self, fs: pafs.FileSystem) -> Iterator[tuple[int, list[str]]]:
        """(place, cells) of the records that begin in the range; blank lines
        are none."""
        csv.field_size_limit(sys.maxsize)
        with _stream(fs, self.path, self.start) as stream:
            at = first_record(stream, self.start, self.state)
            if at is None or at >= self.end:
                return
            if self.state != RECORD:
                stream.seek(at)
            lines = _Lines(stream, at)
            reader = csv.reader(lines)
            while lines.at < self.end:
                at = lines.at
                cells = next(reader, None)
                if cells is None:
                    return
                if cells:
                    if at == 0:
                        cells[0] = cells[0].removeprefix("﻿")
                    yield at, cells


class RangePartition(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def _packed(ranges: list[Range], size: int) -> list[RangePartition]:
    """Ranges in partitions of about ``size`` bytes."""
    out, held, n = [], [], 0
    for r in ranges:
        if held and n + min(r.end - r.start, size) > size:
            out.append(RangePartition(held))
            held, n = [], 0
        held.append(r)
        n += min(r.end - r.start, size)
    return [*out, RangePartition(held)] if held else out


class StateReader(DataSourceReader):
    """Step 1: (file, start, end, step, header) of each range."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        fs, root = _fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else sorted(
            (f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True))
             if f.type == pafs.FileType.File and not any(p[:1] in "_." for p in f.path[len(root):].strip("/").split("/"))),
            key=lambda f: f.path)
        ranges = []
        for f in files:
            if f.path.endswith(COMPRESSED):
                ranges.append(Range(f.path, 0, TO_THE_END))
            else:
                ranges += [Range(f.path, a, min(f.size, a + self.size)) for a in range(0, f.size, self.size)]
        last = {r.path: r.start for r in ranges}
        for r in ranges:  # nothing follows the last range of a file: its function is not needed
            r.state = RECORD if r.start < last[r.path] else -1
        return _packed(ranges, self.size)

    def read(self, partition):
        fs, _ = _fs(self.path)
        for r in partition.ranges:
            step = 0
            if r.state >= 0:
                with _stream(fs, r.path, r.start) as stream:
                    left = r.end - r.start
                    while left and (piece := stream.read(min(PIECE, left))):
                        step, left = int(COMPOSED[step, transition(piece)]), left - len(piece)
            header = None
            if r.start == 0:
                first = next(Range(r.path, 0, TO_THE_END).records(fs), None)
                header = first[1] if first else None
            yield r.path, r.start, r.end, step, header


class RecordReader(DataSourceReader):
    """Step 2: the records of each range, as text cells under the asked names."""

    def __init__(self, path: str, plan: str, names: list[str], size: int, strict: bool):
        self.path, self.plan, self.names, self.size, self.strict = path, plan, names, size, strict

    def partitions(self):
        fs, root = _fs(self.plan)
        rows = pads.dataset(root, filesystem=fs, format="parquet").to_table().to_pylist()
        headers = {r["file"]: tuple(r["header"]) for r in rows if r["header"] is not None}
        rows.sort(key=lambda r: (r["file"], r["start"]))
        ranges = [Range(r["file"], r["start"], r["end"], r["state"], headers[r["file"]]) for r in rows if r["file"] in headers]
        return _packed(ranges, self.size)

    def read(self, partition):
        fs, _ = _fs(self.path)
        columns: list[list] = [[] for _ in self.names]
        held = 0
        for r in partition.ranges:
            place = {c: i for i, c in reversed(list(enumerate(r.header)))}
            missing = [c for c in self.names if c not in place]
            if missing and self.strict:
                raise ValueError(f"{r.path} has no column {', '.join(missing)}")
            at_of = [place.get(c, len(r.header)) for c in self.names]
            for at, cells in r.records(fs):
                if at == 0:
                    continue  # the header
                if len(cells) != len(r.header):
                    if self.strict:
                        raise ValueError(f"{r.path}: the record at byte {at} has {len(cells)} cells, the header {len(r.header)}")
                    cells = (cells + [None] * len(r.header))[:len(r.header)]
                cells.append(None)
                for column, i in zip(columns, at_of):
                    column.append(cells[i])
                held += 64 + sum(len(cells[i] or "") for i in at_of)
                if held > PIECE:
                    yield self._batch(columns)
                    columns, held = [[] for _ in self.names], 0
        if columns and columns[0]:
            yield self._batch(columns)

    def _batch(self, columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=self.names)


class CsvRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, start long, end long, step int, header array<string>"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        size = int(o["rangeBytes"])
        if "plan" not in o:
            return StateReader(o["path"], size)
        return RecordReader(o["path"], o["plan"], schema.fieldNames(), size, o.get("strict", "true") == "true")


def _resolve(table: pa.Table) -> pa.Table:
    """The first state of each range of a file, from the functions of those before."""
    table = table.sort_by("start")
    state, states = RECORD, []
    for step in table.column("step").to_pylist():
        states.append(state)
        state = FUNCTIONS[step][state]
    return table.drop_columns(["step"]).append_column("state", pa.array(states, pa.int32()))


def scan(spark: SparkSession, path: str, names: list[str], range_bytes: int | None = None,
         strict: bool = True) -> tuple[DataFrame, list[str]]:
    """(cells, header): the named columns of the CSV file or folder as text, and
    the names that the first file has.

    Cells may be quoted, with doubled quotes, commas and line breaks in them.
    Every file has a header; columns are found by name in each. A missing
    column, or a record with too many or too few cells, fails the job with its
    place; without ``strict`` such cells are null. Ranges hold ``range_bytes``
    (by default the session's ``spark.sql.files.maxPartitionBytes``).
    """
    ship_package(spark)
    spark.dataSource.register(CsvRanges)
    size = range_bytes or int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    asked = spark.read.format(FORMAT).option("rangeBytes", size)
    plan = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-plan-{uuid.uuid4().hex}"
    asked.load(path).groupBy("file").applyInArrow(
        _resolve, "file string, start long, end long, header array<string>, state int").write.parquet(plan)
    first = spark.read.parquet(plan).where("header is not null").orderBy("file").select("header").first()
    header = list(first["header"]) if first else []
    cells = asked.option("plan", plan).option("strict", str(strict).lower()).schema(
        ", ".join(f"`{n}` string" for n in names)).load(path)
    return cells, header
