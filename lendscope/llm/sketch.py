"""Count-min sketches that partitions fill apart and merge by slices of cells.

A sketch has `ROWS` rows of `width` cells; a value adds one to a cell of each row, and its
estimate, the least of these, is never below its count. Only whether a count reaches two is
asked, so a partition sends, for each slice of cells, which ones it has met once and which
more often. A merged slice is one bit a cell, and the whole sketch ROWS * width bits, a size
set beforehand: that is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lendscope.llm import words as W
from lendscope.llm.scratch import stored

ROWS = 2
SLICE = 1 << 20
PARTIAL = "row int, slice int, once binary, often binary"
MERGED = "row int, slice int, bits binary"
FLUSH = 4 << 20


def width_for(values: int, largest: int) -> int:
    """Four cells a value, as a power of two, up to `largest`."""
    return min(largest, max(1 << 10, 1 << (4 * values - 1).bit_length() if values else 1))


def cells(values: np.ndarray, row: int, width: int) -> np.ndarray:
    spread = W.mix(values + np.uint64(0xD1B54A32D192ED03 * (row + 1) & (1 << 64) - 1))
    return (spread & np.uint64(width - 1)).astype(np.int64)


def _coded(numbers: np.ndarray) -> bytes:
    """Sorted numbers below 2**32 as steps, by planes of bytes, which compress well."""
    steps = np.diff(numbers, prepend=0).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def partial(values: Iterable[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """The sketch of one partition (PARTIAL), in parts if it has many values."""

    def flushed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        met = np.concatenate(held)
        for row in range(ROWS):
            cell, count = np.unique(cells(met, row, width), return_counts=True)
            size = min(SLICE, width)
            edges = np.searchsorted(cell, np.arange(0, width + size, size))
            rows = []
            for k in np.flatnonzero(np.diff(edges)):
                own, many = cell[edges[k] : edges[k + 1]] - k * size, count[edges[k] : edges[k + 1]] > 1
                rows.append((row, int(k), _coded(own[~many]), _coded(own[many])))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                names=["row", "slice", "once", "often"],
            )

    held, size = [], 0
    for found in values:
        held.append(found)
        size += len(found)
        if size > FLUSH:
            yield from flushed(held)
            held, size = [], 0
    if size:
        yield from flushed(held)


def _merge(width: int):
    size = min(SLICE, width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, once, often):
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                 pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary())],
                names=["row", "slice", "bits"],
            )

        key, once, often = None, None, None
        for batch in batches:
            for row, part, few, many in zip(
                *(batch.column(n).to_pylist() for n in ("row", "slice", "once", "often")), strict=True
            ):
                if (row, part) != key:
                    if key is not None:
                        yield done(key, once, often)
                    key, once, often = (row, part), np.zeros(size, bool), np.zeros(size, bool)
                seen = _decoded(few)
                often[seen[once[seen]]] = True
                once[seen] = True
                seen = _decoded(many)
                often[seen] = True
                once[seen] = True
        if key is not None:
            yield done(key, once, often)

    return merge


def repeated_cells(partials: DataFrame, width: int) -> np.ndarray:
    """Merge partition sketches: bits, by row, of the cells with a count of two or more."""
    slices = ROWS * max(1, width // SLICE)
    merged = stored(
        partials.repartition(min(slices, 512), "row", "slice")
        .sortWithinPartitions("row", "slice")
        .mapInArrow(_merge(width), MERGED),
        "sketch",
    )
    bits = np.zeros((ROWS, width // 8), np.uint8)
    size = min(SLICE, width) // 8
    for row in merged.toLocalIterator():
        bits[row["row"], row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def maybe_repeated(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether a value's estimate is two or more: true for every value that comes twice."""
    out = np.ones(len(values), bool)
    for row in range(ROWS):
        cell = cells(values, row, bits.shape[1] * 8)
        out &= (bits[row, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out
