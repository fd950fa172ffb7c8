"""Symbols, calls and imports of source files: one parse a file, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import language
from ..parse import scan

_FIELDS = (("ord", pa.int32(), "int"), ("name", pa.string(), "string"), ("kind", pa.string(), "string"), ("byte_start", pa.int32(), "int"), ("byte_end", pa.int32(), "int"), ("line_start", pa.int32(), "int"), ("line_end", pa.int32(), "int"))


def parse(files: DataFrame) -> DataFrame:
    """doc_id, path, what (symbol, call or import), ord, name, kind, byte_start, byte_end, line_start, line_end: all that a single parse of each file gives. Filter the files first: only what is left is parsed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, path, lang, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows += [(i, path, "symbol", n, s.name, s.kind, *s[2:]) for n, s in enumerate(scan.symbols(raw, lang))]
                rows += [(i, path, "call", n, c.name, None, c.at, None, None, None) for n, c in enumerate(scan.calls(raw, lang))]
                rows += [(i, path, "import", n, t, *[None] * 5) for n, t in enumerate(scan.imports(raw, lang))]
            kinds = (pa.int64(), pa.string(), pa.string(), *(f[1] for f in _FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "path", "what", *(f[0] for f in _FIELDS)])

    schema = "doc_id long, path string, what string, " + ", ".join(f"{n} {t}" for n, _, t in _FIELDS)
    known = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", language(F.col("path")).alias("lang"), "text").where("lang is not null")
    return known.mapInArrow(run, schema)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.where("what = 'symbol'").drop("what")


def calls(parsed: DataFrame) -> DataFrame:
    """doc_id, path, callee, at."""
    return parsed.where("what = 'call'").select("doc_id", "path", F.col("name").alias("callee"), F.col("byte_start").alias("at"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.where("what = 'import'").select("path", F.col("name").alias("target"))
