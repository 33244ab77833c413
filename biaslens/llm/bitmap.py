"""A bitmap of hash values, of bounded size, for leaving rows at home early.

A wrong mark only lets a row travel to an exact join later, so the bitmap
never decides a result, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 17
MAX_BITS = 27  # 16 MB


def bits_for(n: int) -> int:
    """Sixteen cells an entry, as far as the bound allows."""
    return min(MAX_BITS, max(BLOCK_BITS, (16 * n).bit_length()))


def marks_of(hashes: DataFrame, column: str, bits: int) -> dict[int, bytes]:
    """Packed blocks of the top ``bits`` bits of a long column; at most
    2^MAX_BITS bits reach the driver."""
    def pack(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        marks[table.column("offset").to_numpy()] = 1
        return pa.table({"block": table.column("block")[:1], "marks": pa.array([np.packbits(marks).tobytes()])})

    cell = F.shiftrightunsigned(column, 64 - bits)
    cells = hashes.select(
        F.shiftrightunsigned(cell, BLOCK_BITS).alias("block"),
        cell.bitwiseAND((1 << BLOCK_BITS) - 1).alias("offset")).distinct()
    rows = cells.groupBy("block").applyInArrow(pack, "block long, marks binary").collect()
    return {r["block"]: bytes(r["marks"]) for r in rows}


class Marks:
    """The bitmap in a task."""

    def __init__(self, blocks: dict[int, bytes], bits: int):
        self.bits = bits
        self.cells = np.zeros(1 << (bits - 3), dtype=np.uint8)
        size = 1 << (BLOCK_BITS - 3)
        for b, packed in blocks.items():
            self.cells[b * size:(b + 1) * size] = np.frombuffer(packed, dtype=np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes.astype(np.uint64, copy=False) >> np.uint64(64 - self.bits)
        return (self.cells[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1


def among(hashes: DataFrame, column: str, key: str) -> Column:
    """Whether a row's ``key`` (long, not null) may be one of the ``hashes``: rows
    that are not among them need not travel to meet a partner."""
    bits = bits_for(hashes.count())
    shared = hashes.sparkSession.sparkContext.broadcast((marks_of(hashes, column, bits), bits))

    @F.arrow_udf("boolean")
    def found(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Marks(*shared.value)
        for part in keys:
            yield pa.array(marks(part.to_numpy(zero_copy_only=False).view(np.uint64)))

    return found(F.col(key))
