"""Join documents to what they lose, without a shuffle of the texts of those that lose nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling, sketch
from .common import KEYS, arrow_map, same_row, table


def finish(keyed: DataFrame, removed: DataFrame, result: Callable[[str | None, object], tuple], fields: tuple[tuple[str, pa.DataType, str], ...]) -> DataFrame:
    """doc_id and `fields` (name, Arrow type, Spark type; the first is never null) of all rows of keyed (doc_id, text, and KEYS).

    removed is a table (doc_id, KEYS, lost), one row for each document that loses something;
    result gives the fields of a text and its `lost`, or None. A bit for each row of
    removed tells nearly all other documents apart while they are scanned.
    """
    row_hash = F.xxhash64("doc_id", *KEYS).alias("h")
    some = sketch.repeated(removed.select(row_hash), lambda b: iter([np.repeat(rolling.mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), 2)]), sketch.cells_for(removed.count()))
    names = ["doc_id", *(f[0] for f in fields)]

    def columns(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[i] for r in rows], f[1]) for i, f in enumerate(fields)]

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = some(rolling.mixed(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64))).tolist()
            texts = [t.as_py() for t in b.column("text")]
            rows = [(None,) * len(fields) if wait else result(t, None) for t, wait in zip(texts, held, strict=True)]
            text = pa.array([t if wait else None for t, wait in zip(texts, held, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(k) for k in KEYS), *columns(rows), text], names=["doc_id", *KEYS, *names[1:], "text"])

    results = ", ".join(f"{f[0]} {f[2]}" for f in fields)
    first = table(arrow_map(keyed.select("doc_id", *KEYS, "text", row_hash), whole, f"doc_id long, key long, key2 long, {results}, text string"), "removal-first")
    r = removed.select(F.col("doc_id").alias("__id"), *(F.col(k).alias(f"__{k}") for k in KEYS), "lost")
    done = F.col(names[1]).isNotNull()
    waiting = first.where(~done).select("doc_id", *KEYS, "text")
    joined = waiting.join(r, same_row(waiting, r), "left").select("doc_id", "text", "lost")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [result(t.as_py(), p.values.to_numpy(zero_copy_only=False) if p.is_valid else None) for t, p in zip(b.column("text"), b.column("lost"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns(rows)], names=names)

    return first.where(done).select(*names).unionByName(arrow_map(joined, apply, f"doc_id long, {results}"))
