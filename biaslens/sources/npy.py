"""Array files (``.npy``) as keyed tables.

Model code keeps its matrices as array files whose rows belong together by
place only. Here they are scanned in row ranges, spread over the cluster, and
every row carries its ``position``; several arrays of one length are read side
by side, so ids and features meet without a join. The sink writes a folder of
parts, in the order of their names.

A header is read once a file, by the planner; a task seeks to its rows.
"""

from __future__ import annotations

import ast
import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package
from .csv_ranges import _fs

FORMAT = "npy_rows"
MAGIC = b"\x93NUMPY"
PIECE = 1 << 22         # bytes of a batch
ROWS_PER_PART = 1 << 20
# Spark and numpy types of the cells of an array file; unsigned and
# half-precision ones are widened.
CELLS = {"b1": (T.BooleanType(), "?"), "i1": (T.ByteType(), "i1"), "i2": (T.ShortType(), "i2"),
         "i4": (T.IntegerType(), "i4"), "i8": (T.LongType(), "i8"), "u1": (T.ShortType(), "i2"),
         "u2": (T.IntegerType(), "i4"), "u4": (T.LongType(), "i8"), "f2": (T.FloatType(), "f4"),
         "f4": (T.FloatType(), "f4"), "f8": (T.DoubleType(), "f8")}
STORED = {T.BooleanType(): "|b1", T.ByteType(): "|i1", T.ShortType(): "<i2", T.IntegerType(): "<i4",
          T.LongType(): "<i8", T.FloatType(): "<f4", T.DoubleType(): "<f8"}


@dataclass(frozen=True)
class Part:
    """An array file: where its cells begin, and which rows of the whole it has."""
    path: str
    dtype: str
    rows: int
    width: int | None       # None: one cell a row, not an array
    by_column: bool         # stored column after column
    at: int
    first: int = 0

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * (1 if self.width is None else self.width)

    @property
    def kind(self) -> str:
        return np.dtype(self.dtype).str[1:]

    def spark_type(self) -> T.DataType:
        cell = CELLS[self.kind][0]
        return cell if self.width is None else T.ArrayType(cell)

    def cells(self, stream, lo: int, hi: int) -> np.ndarray:
        """Rows [lo, hi) of the file, in the machine's byte order."""
        dtype, size = np.dtype(self.dtype), np.dtype(self.dtype).itemsize

        def run(first: int, n: int) -> np.ndarray:
            stream.seek(self.at + first * size)
            read = stream.read(n * size)
            if len(read) < n * size:
                raise ValueError(f"{self.path} ends before its {self.rows} rows do")
            return np.frombuffer(read, dtype)

        width = 1 if self.width is None else self.width
        if self.by_column and width > 1:
            found = np.stack([run(j * self.rows + lo, hi - lo) for j in range(width)], axis=1)
        else:
            found = run(lo * width, (hi - lo) * width)
        return found.astype(CELLS[self.kind][1], copy=False).reshape(hi - lo, width)


def part_of(path: str, stream) -> Part:
    """The file's header: format version, then a dictionary in text."""
    lead = stream.read(8)
    if lead[:6] != MAGIC:
        raise ValueError(f"{path} is not an array file")
    size = int.from_bytes(stream.read(2 if lead[6] == 1 else 4), "little")
    said = ast.literal_eval(stream.read(size).decode("utf-8" if lead[6] > 2 else "latin1"))
    shape, dtype = said["shape"], said["descr"]
    if not isinstance(dtype, str) or np.dtype(dtype).str[1:] not in CELLS:
        raise ValueError(f"{path} holds {dtype}, which no column can hold")
    if len(shape) not in (1, 2):
        raise ValueError(f"{path} has {len(shape)} dimensions; rows have one or two")
    return Part(path, dtype, shape[0], shape[1] if len(shape) == 2 else None, said["fortran_order"], stream.tell())


def _files(path: str) -> list[str]:
    fs, root = _fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [root]
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root))
                   if f.type == pafs.FileType.File and f.base_name.endswith(".npy") and f.base_name[0] not in "_.")
    if not found:
        raise FileNotFoundError(f"{path} holds no array file")
    return found


def _header(fs: pafs.FileSystem, path: str) -> Part:
    with fs.open_input_file(path) as stream:
        return part_of(path, stream)


def parts_of(path: str) -> list[Part]:
    """The files of an array in order, each with its first row."""
    fs, files = _fs(path)[0], _files(path)
    with ThreadPoolExecutor(32) as pool:
        parts = list(pool.map(lambda f: _header(fs, f), files))
    out, first = [], 0
    for p in parts:
        if (p.spark_type(), p.width) != (parts[0].spark_type(), parts[0].width):
            raise ValueError(f"{p.path} and {parts[0].path} have different rows")
        out.append(Part(p.path, p.dtype, p.rows, p.width, p.by_column, p.at, first))
        first += p.rows
    return out


class RowRange(InputPartition):
    """Rows [lo, hi), and per column the files that hold them."""

    def __init__(self, lo: int, hi: int, parts: dict[str, list[Part]]):
        self.lo, self.hi, self.parts = lo, hi, parts


class RowReader(DataSourceReader):
    def __init__(self, columns: dict[str, str], range_bytes: int):
        self.columns, self.range_bytes = columns, range_bytes

    def partitions(self):
        parts = {c: parts_of(path) for c, path in self.columns.items()}
        rows = {c: p[-1].first + p[-1].rows for c, p in parts.items()}
        if len(set(rows.values())) > 1:
            raise ValueError(f"arrays of different length can't be read side by side: {rows}")
        n = next(iter(rows.values()))
        step = max(1, self.range_bytes // max(1, sum(p[0].row_bytes for p in parts.values())))
        at, out = {c: 0 for c in parts}, []
        for lo in range(0, max(n, 1), step):
            hi, held = min(n, lo + step), {}
            for c, p in parts.items():
                while at[c] < len(p) - 1 and p[at[c]].first + p[at[c]].rows <= lo:
                    at[c] += 1
                last = at[c]
                while last < len(p) and p[last].first < hi:
                    last += 1
                held[c] = p[at[c]:last]
            out.append(RowRange(lo, hi, held))
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.lo == partition.hi:
            return
        streams: dict[str, io.IOBase] = {}
        width = sum(p[0].row_bytes for p in partition.parts.values())
        step = max(1, PIECE // max(1, width))
        try:
            for lo in range(partition.lo, partition.hi, step):
                hi = min(partition.hi, lo + step)
                arrays = [self._column(c, partition.parts[c], lo, hi, streams) for c in self.columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), *arrays], names=["position", *self.columns])
        finally:
            for s in streams.values():
                s.close()

    def _column(self, column: str, parts: list[Part], lo: int, hi: int, streams: dict) -> pa.Array:
        found = []
        for p in parts:
            a, b = max(lo, p.first) - p.first, min(hi, p.first + p.rows) - p.first
            if a < b:
                if p.path not in streams:
                    streams[p.path] = _fs(self.columns[column])[0].open_input_file(p.path)
                found.append(p.cells(streams[p.path], a, b))
        cells = np.concatenate(found)
        flat = pa.array(cells.ravel())
        if parts[0].width is None:
            return flat
        return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), flat)


class NpyRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> dict[str, str]:
        return json.loads(self.options["columns"])

    def schema(self) -> T.StructType:
        fields = [T.StructField("position", T.LongType())]
        for c, path in self._columns().items():
            first = _header(_fs(path)[0], _files(path)[0])
            fields.append(T.StructField(c, first.spark_type()))
        return T.StructType(fields)

    def reader(self, schema) -> DataSourceReader:
        return RowReader(self._columns(), int(self.options["rangeBytes"]))


def read_arrays(spark: SparkSession, columns: dict[str, str], range_bytes: int | None = None) -> DataFrame:
    """(position, one column per array): the rows of array files side by side.

    ``columns`` maps a name to a file, or to a folder of files in the order of
    their names. A one-dimensional array gives a cell a row, a two-dimensional
    one an array a row; rows count from 0. Either storage order and byte order
    is read. Arrays of different length, parts of different rows, a file that
    ends early and cells without a Spark type fail the job. Arrays without rows
    give none. Ranges hold ``range_bytes`` (by default the session's
    ``spark.sql.files.maxPartitionBytes``).
    """
    if not columns or any(c.lower() == "position" for c in columns):
        raise ValueError("name at least one array, none of them position")
    ship_package(spark)
    spark.dataSource.register(NpyRows)
    size = range_bytes or int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return spark.read.format(FORMAT).option("columns", json.dumps(columns)).option("rangeBytes", size).load()


def _lead(dtype: str, rows: int, width: int | None) -> bytes:
    held = io.BytesIO()
    shape = (rows,) if width is None else (rows, width)
    np.lib.format.write_array_header_1_0(held, {"descr": dtype, "fortran_order": False, "shape": shape})
    return held.getvalue()


def write_array(df: DataFrame, path: str, values: str, position: str = "position",
                rows_per_part: int = ROWS_PER_PART) -> int:
    """Writes a column, cells or arrays of one length, as the array artefact
    ``path``: a folder of parts. Returns the number of rows.

    ``position`` says the row, from 0 without gaps or repeats. A gap, a repeat,
    a null, arrays of different length and a folder that has parts already fail
    the job. A part appears under its name once it is whole, so a task that runs
    twice leaves the same files. No rows: one part without rows.
    """
    cell = df.schema[values].dataType
    nested = isinstance(cell, T.ArrayType)
    dtype = STORED.get(cell.elementType if nested else cell)
    if dtype is None:
        raise ValueError(f"{values} is {cell.simpleString()}, which no array file can hold")
    fs, root = _fs(path)
    if fs.get_file_info(root).type != pafs.FileType.NotFound and any(
            f.base_name.endswith(".npy") for f in fs.get_file_info(pafs.FileSelector(root))):
        raise FileExistsError(f"{path} has parts already")
    v, at = F.col(f"`{values}`"), F.col(f"`{position}`").cast("long")
    size = F.size(v) if nested else F.lit(1)
    empty = v.isNull() | F.exists(v, lambda x: x.isNull()) if nested else v.isNull()
    n, low, high, nulls, narrow, wide = df.agg(
        F.count(F.lit(1)), F.min(at), F.max(at), F.count_if(empty | at.isNull()), F.min(size), F.max(size)).first()
    if n and (nulls or (low, high) != (0, n - 1) or narrow != wide):
        raise ValueError(f"{values}: {n} rows at positions {low} to {high}, {nulls} nulls, {narrow} to {wide} cells a row")
    width = (wide or 0) if nested else None
    hidden = f"{root}/_parts-{uuid.uuid4().hex}"
    fs.create_dir(hidden, recursive=True)
    if not n:
        with fs.open_output_stream(f"{root}/part-{0:012d}.npy") as stream:
            stream.write(_lead(dtype, 0, width))
        fs.delete_dir(hidden)
        return 0

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(path)
        part, stream, name, due, stored = None, None, None, 0, 0

        def whole() -> None:
            stream.close()
            if due != min(n, (part + 1) * rows_per_part):
                raise ValueError(f"part {part} ends at row {due}")
            fs.move(name, f"{root}/part-{part:012d}.npy")

        for batch in batches:
            places, parts = (batch.column(c).to_numpy() for c in ("at", "part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    if part is not None:
                        whole()
                    part = int(parts[lo])
                    due, name = part * rows_per_part, f"{hidden}/{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(name)
                    stream.write(_lead(dtype, min(n - due, rows_per_part), width))
                if not np.array_equal(places[lo:hi], np.arange(due, due + hi - lo)):
                    raise ValueError(f"positions from {due} on have a gap or a repeat")
                cells = batch.column("v").slice(lo, hi - lo)
                cells = cells.flatten() if nested else cells
                stream.write(cells.to_numpy(zero_copy_only=False).astype(dtype).tobytes())
                due, stored = due + hi - lo, stored + hi - lo
        if part is not None:
            whole()
        yield pa.record_batch([pa.array([stored], pa.int64())], names=["rows"])

    ship_package(df.sparkSession)
    dealt = df.select(F.floor(at / rows_per_part).cast("long").alias("part"), at.alias("at"), v.alias("v")).repartitionByRange(
        -(-n // rows_per_part), "part").sortWithinPartitions("part", "at")
    try:
        stored = dealt.mapInArrow(store, "rows long").agg(F.sum("rows")).first()[0]
    finally:
        fs.delete_dir(hidden)
    if stored != n:
        raise ValueError(f"{stored} of {n} rows were stored")
    return n
