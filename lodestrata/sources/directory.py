"""A directory tree as a Spark source: hidden entries and what .gitignore names are left out, binary files too.

Spark's own file sources drop every path with a step that starts with `_`; this one lists
by its own rules: `spark.read.format("source_tree").load(root)`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id long, path string, size long, mtime timestamp, text string"
INDEX_DIR = ".lodestrata"
SNIFF = 8192
#: Bytes of files that one task reads, about.
PART_BYTES = 16 << 20


def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """What a line of an ignore file matches (a path below that file's folder), whether it brings back, whether only folders."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:].removeprefix("\\")
    folders = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    out, i, line = "", 0, line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            while line.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + "[" + ("^" if line[i + 1] == "!" else "") + line[i + 1 + (line[i + 1] == "!") : end].replace("\\", "\\\\") + "]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if rooted else "(?:.*/)?") + out + r"\Z"), back, folders


def _rules(folder: str) -> list:
    found = []
    for name in (".gitignore", ".git/info/exclude"):
        try:
            with open(os.path.join(folder, name), errors="replace") as f:
                found += [r for r in map(rule, f) if r]
        except OSError:
            continue
    return found


def walk(root: str) -> Iterator[tuple[str, int, float]]:
    """path below root, size and time of change of each regular file that isn't hidden or ignored, by path."""

    def inside(folder: str, below: str, rules: list) -> Iterator[tuple[str, int, float]]:
        rules = [*rules, *((below, *r) for r in _rules(folder))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{below}{e.name}"
            if e.name.startswith(".") or e.is_symlink():
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            ignored = False
            for base, pattern, back, folders in rules:
                if (is_dir or not folders) and pattern.match(path[len(base) :]):
                    ignored = not back
            if ignored:
                continue
            if is_dir:
                yield from inside(e.path, path + "/", rules)
            elif e.is_file(follow_symlinks=False):
                s = e.stat()
                yield path, s.st_size, s.st_mtime

    yield from inside(root, "", [])


class _Part(InputPartition):
    def __init__(self, files: list[tuple[int, str, int, float]]):
        self.files = files


def _text(root: str, path: str) -> str | None:
    """The text of a file; None if it is gone or binary."""
    try:
        with open(os.path.join(root, path), "rb") as f:
            raw = f.read()
    except OSError:
        return None
    return None if b"\0" in raw[:SNIFF] else raw.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, root: str, texts: bool):
        self.root, self.texts = root, texts

    def partitions(self):
        parts, held, size = [], [], 0
        for i, (path, bytes_, mtime) in enumerate(sorted(walk(self.root))):
            held.append((i, path, bytes_, mtime))
            size += bytes_
            if size >= PART_BYTES:
                parts.append(_Part(held))
                held, size = [], 0
        return [*parts, _Part(held)]

    def read(self, partition):
        rows = []
        for i, path, size, mtime in partition.files:
            text = _text(self.root, path) if self.texts else None
            if self.texts and text is None:
                continue
            rows.append((i, path, size, datetime.fromtimestamp(mtime, timezone.utc), text))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "path", "size", "mtime", "text"])


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("texts", "true") == "true")


def files(spark: SparkSession, root: str, texts: bool = True):
    """doc_id (rank by path), path, size, mtime, text of a tree that driver and executors see. texts=False lists only."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", root).option("texts", str(texts).lower()).load()


def read(listing, root: str):
    """The rows of a listing with their text: only these files are opened; binary and vanished ones are left out."""

    def run(batches):
        for b in batches:
            texts = [_text(root, p) for p in b.column("path").to_pylist()]
            b = pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])
            yield b.filter(pa.array([t is not None for t in texts], pa.bool_()))

    rows = listing.select("doc_id", "path", "size", "mtime")
    return rows.mapInArrow(run, "doc_id long, path string, size long, mtime timestamp, text string")
