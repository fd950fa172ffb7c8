"""Text search: lines, matches with byte offsets, the trigram index and searches planned over it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import regex

#: Beyond this share of all files a candidate list saves nothing, and the files are scanned.
SCAN_SHARE = 0.5
#: Candidates up to which their ids are written into the scan's filter, and up to which they are broadcast.
FEW_IDS, BROADCAST_IDS = 500, 1_000_000


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """doc_id, path, line_number (from 1), line; a newline at the end leaves an empty last line."""
    return files.select("doc_id", "path", *keep, F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_number", (F.col("pos") + 1).cast("int")).drop("pos")


def offsets(line: Column, java: str) -> tuple[Column, Column]:
    """Bytes before and up to the end of the first match of a line that has one."""
    at = F.regexp_instr(line, F.lit(java))
    start = F.octet_length(F.left(line, at - 1))
    found = F.coalesce(F.regexp_substr(line, F.lit(java)), F.lit(""))
    return start.cast("int"), (start + F.octet_length(found)).cast("int")


def search(files: DataFrame, pattern: str) -> DataFrame:
    """path, doc_id, line_number, line, match_start, match_end: a row for each line with a match, for its first one."""
    java = regex.to_java(pattern)
    hit = lines(_with_literals(files, pattern)).where(F.col("line").rlike(java))
    start, end = offsets(F.col("line"), java)
    return hit.select("path", "doc_id", "line_number", "line", start.alias("match_start"), end.alias("match_end"))


def _with_literals(files: DataFrame, pattern: str) -> DataFrame:
    """Files that hold the trigrams which the pattern requires, as far as they are whole characters: cheap tests before the lines are cut."""
    plan = regex.of_pattern(pattern)
    needed = [p.value.to_bytes(3, "big") for p in (plan.parts if isinstance(plan, regex.All) else (plan,)) if isinstance(p, regex.Gram)]
    for raw in needed:
        try:
            files = files.where(F.contains("text", F.lit(raw.decode())))
        except UnicodeDecodeError:
            continue
    return files


def postings(files: DataFrame) -> DataFrame:
    """gram, doc_id: the distinct byte trigrams of each text, packed big-endian.

    A map without a shuffle. The windows are made and sorted by numpy a text at a time:
    the same by array functions on binaries compares all pairs of windows of a text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, found = [], [np.zeros(0, np.int32)]
                for i, text in zip(part.column(0), part.column(1), strict=True):
                    raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
                    if len(raw) >= 3:
                        g = np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])
                        found.append(g)
                        ids.append(np.full(len(g), i.as_py(), np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], names=["gram", "doc_id"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "gram int, doc_id long")


def candidates(index: DataFrame, plan) -> DataFrame | None:
    """doc_id of the files that a plan admits; None if it admits all.

    A conjunction of grams is one count over the rows of those grams; other trees are
    put together by semi-joins and distinct unions.
    """
    if plan == regex.ANY:
        return None
    if isinstance(plan, regex.Gram):
        return index.where(F.col("gram") == plan.value).select("doc_id")
    if isinstance(plan, regex.Either):
        if all(isinstance(p, regex.Gram) for p in plan.parts):
            return index.where(F.col("gram").isin(*(p.value for p in plan.parts))).select("doc_id").distinct()
        out = None
        for p in plan.parts:
            c = candidates(index, p)
            out = c if out is None else out.unionByName(c)
        return out.distinct()
    single = [p.value for p in plan.parts if isinstance(p, regex.Gram)]
    out = None
    if single:
        out = index.where(F.col("gram").isin(*single)).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(single)).select("doc_id")
    for p in plan.parts:
        if not isinstance(p, regex.Gram):
            c = candidates(index, p)
            out = c if out is None else out.join(c, "doc_id", "left_semi")
    return out


def indexed_search(files: DataFrame, index: DataFrame, pattern: str, file_count: int | None = None) -> DataFrame:
    """As search(), over the candidate files only. With file_count, the candidates are counted first: a few ids become a filter of the scan; more than SCAN_SHARE of the files are scanned instead; up to BROADCAST_IDS ids are broadcast."""
    found = candidates(index, regex.of_pattern(pattern))
    if found is None:
        return search(files, pattern)
    if file_count is not None:
        ids = [r.doc_id for r in found.limit(FEW_IDS + 1).collect()]
        if len(ids) <= min(FEW_IDS, SCAN_SHARE * file_count):  # the ids go into the scan's filter, which leaves out row groups and pages
            return search(files.where(F.col("doc_id").isin(ids)), pattern)
        n = found.count()
        if n > SCAN_SHARE * file_count:
            return search(files, pattern)
        found = F.broadcast(found) if n <= BROADCAST_IDS else found
    return search(files.join(found, "doc_id", "left_semi"), pattern)


def search_many(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """pattern_id and the columns of search() for several patterns in one pass over the lines."""
    java = {k: regex.to_java(p) for k, p in patterns.items()}
    tests = [F.when(F.col("line").rlike(j), F.struct(F.lit(k).alias("pattern_id"), *(x.alias(n) for x, n in zip(offsets(F.col("line"), j), ("match_start", "match_end"), strict=True)))) for k, j in java.items()]
    hits = lines(files).where(F.greatest(*[F.col("line").rlike(j) for j in java.values()], F.lit(False)))
    each = hits.withColumn("m", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    return each.select("m.pattern_id", "path", "doc_id", "line_number", "line", "m.match_start", "m.match_end")


def count_matches(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("matches"))


def files_with_matches(matches: DataFrame) -> DataFrame:
    """doc_id, path of each file with a match."""
    return matches.select("doc_id", "path").distinct()
