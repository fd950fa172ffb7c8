"""A count-min sketch of 64-bit hashes, built per partition, merged by segments, and read as the bits "counted at least twice".

Each partition writes, for each of two rows of the sketch and each segment of 2**20 cells,
the cells it has counted once and those it has counted more often, as gaps of a byte. The
merge adds one segment at a time. Counts stop at 2: an estimate is never below the true
count as far as that, so nothing that repeats is lost.

The rows have `cells` cells each, four for each expected hash, but at most MOST_CELLS:
the merged bits, which are broadcast, take 2 * MOST_CELLS / 8 bytes at most. Beyond that
size of input the sketch lets more unique hashes pass; the exact pass behind it then has
more to group, and its result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

SEGMENT_BITS = 20
MOST_CELLS = 1 << 29
#: Hashes that a task holds before it writes them to a partial sketch.
FLUSH = 4_000_000


def cells_for(expected: int) -> int:
    return min(MOST_CELLS, 1 << max(SEGMENT_BITS, (4 * max(1, expected) - 1).bit_length()))


def encode(sorted_cells: np.ndarray) -> bytes:
    """Ascending cell numbers as gaps: 255 adds 255 to the gap and goes on, a smaller byte ends it."""
    if not len(sorted_cells):
        return b""
    gaps = np.diff(sorted_cells.astype(np.int32), prepend=np.int32(0))
    more = gaps // 255
    ends = np.cumsum(more + 1, dtype=np.int32) - 1
    out = np.full(int(ends[-1]) + 1, 255, np.uint8)
    out[ends] = gaps - more * 255
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return np.cumsum(a, dtype=np.int64)[a < 255]


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.int64)


def _partial(h: np.ndarray, cells: int) -> Iterator[tuple[int, bool, bytes]]:
    """segment (of both rows, in turn), whether counted more than once, the cells."""
    segments = cells >> SEGMENT_BITS
    for row in (0, 1):
        c = ((h >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.uint32)  # a task holds millions
        c.sort()
        first = np.concatenate([[True], c[1:] != c[:-1]])
        once = first & np.concatenate([c[1:] != c[:-1], [True]])
        for many, found in ((False, c[once]), (True, c[first & ~once])):
            edges = np.searchsorted(found, (np.arange(segments + 1, dtype=np.int64) << SEGMENT_BITS).astype(np.uint32))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                yield row * segments + s, many, encode(found[edges[s] : edges[s + 1]] - np.uint32(s << SEGMENT_BITS))


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int) -> "Repeated":
    """Sketch what `hashes` gives for each batch of df; the result tells which hashes may repeat."""
    spark = df.sparkSession

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            rows = list(_partial(every, cells))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "many", "data"])

        for b in batches:
            for h in hashes(b):
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, counts = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

        for b in batches:
            for s, many, data in zip(b.column("segment").to_pylist(), b.column("many").to_pylist(), b.column("data"), strict=True):
                if s != segment:
                    if segment is not None:
                        yield done()
                    segment, counts = s, np.zeros(1 << SEGMENT_BITS, np.uint8)
                at = decode(data.as_buffer().to_pybytes())
                counts[at] = np.minimum(counts[at] + (2 if many else 1), 2)
        if segment is not None:
            yield done()

    parts = arrow_map(df, build, "segment int, many boolean, data binary")
    tasks = max(1, min(2 * (cells >> SEGMENT_BITS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = arrow_map(parts.repartition(tasks, "segment").sortWithinPartitions("segment"), merge, "segment int, bits binary")
    size = 1 << SEGMENT_BITS - 3
    bits = np.zeros((2 * (cells >> SEGMENT_BITS), size), np.uint8)
    for r in merged.toLocalIterator():
        bits[r.segment] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bits.tobytes())
    return Repeated(shared, cells)


class Repeated:
    """The merged bits, for use in tasks."""

    def __init__(self, shared, cells: int):
        self.shared, self.cells = shared, cells

    def done(self) -> None:
        """Free the executors' copies; they come again if they are needed after all."""
        self.shared.unpersist()

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.shared.value, np.uint8).reshape(2, -1)
        out = np.ones(len(h), bool)
        for row in (0, 1):
            c = cells_of(h, row, self.cells)
            out &= (bits[row][c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return out
