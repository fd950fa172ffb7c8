"""Lines and calls put into the symbols that enclose them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import regex
from .search import lines

MODULE = "<module>"


def _before() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)


def line_offsets(files: DataFrame) -> DataFrame:
    """doc_id, line_number, byte_offset of each line's start: a running sum of bytes and newlines."""
    sizes = lines(files).select("doc_id", "line_number", F.octet_length("line").alias("bytes"))
    return sizes.select("doc_id", "line_number", F.coalesce(F.sum(F.col("bytes") + 1).over(_before()), F.lit(0)).alias("byte_offset"))


def enclose(points: DataFrame, symbols: DataFrame, at: str, key: list[str]) -> DataFrame:
    """points, each with `symbol`: the smallest symbol of its file around the offset `at`, of equal ones the first; null where there is none.

    An equi-join on the file with the range as a condition, then a minimum per point, which
    is combined before it is shuffled.
    """
    s = symbols.select(F.col("doc_id").alias("__doc"), F.col("byte_start").alias("__start"), F.col("byte_end").alias("__end"), F.struct((F.col("byte_end") - F.col("byte_start")).alias("size"), "ord", "kind", "name", "byte_start", "byte_end", "line_start", "line_end").alias("symbol"))
    inside = (F.col("doc_id") == F.col("__doc")) & (F.col("__start") <= F.col(at)) & (F.col(at) < F.col("__end"))
    rest = [c for c in points.columns if c not in key]
    return points.join(s, inside, "left").groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], F.min("symbol").alias("symbol"))


def matches_in_symbols(files: DataFrame, symbols: DataFrame, pattern: str) -> DataFrame:
    """Each matching line with the symbol around its start.

    One pass over the texts: those without a match are left out by the pattern on the whole
    text, and of the others' lines only sizes, and the matching lines, meet per file.
    """
    java = regex.to_java(pattern)
    if not re.search(r"\\[AzZ]", pattern):  # these mean the line's ends below, and the text's here
        files = files.where(F.col("text").rlike(java.replace("(?dU)", "(?dUm)", 1)))
    hit = F.col("line").rlike(java)
    cut = lines(files).select("doc_id", "path", "line_number", F.octet_length("line").alias("bytes"), F.when(hit, F.col("line")).alias("line"))
    at = F.coalesce(F.sum(F.col("bytes") + 1).over(_before()), F.lit(0)).alias("byte_offset")
    found = cut.select("doc_id", "path", "line_number", "line", at).where("line is not null")
    return enclose(found, symbols, "byte_offset", ["doc_id", "path", "line_number"])


def structural_search(files: DataFrame, symbols: DataFrame, pattern: str, with_body: bool = False) -> DataFrame:
    """path, doc_id, symbol_name, symbol_kind, line_start, line_end, byte_start, byte_end, match_line_number, match_line: each symbol with a match once, with its first line; each matching line outside of symbols as <module>."""
    found = matches_in_symbols(files, symbols, pattern)
    hit = F.struct(F.col("line_number").alias("n"), F.col("line").alias("line"), "symbol")
    inside = found.where("symbol is not null").groupBy("doc_id", "path", F.col("symbol.byte_start").alias("byte_start"), F.col("symbol.byte_end").alias("byte_end")).agg(F.min(hit).alias("m"))
    inside = inside.select("path", "doc_id", F.col("m.symbol.name").alias("symbol_name"), F.col("m.symbol.kind").alias("symbol_kind"), F.col("m.symbol.line_start").alias("line_start"), F.col("m.symbol.line_end").alias("line_end"), "byte_start", "byte_end", F.col("m.n").alias("match_line_number"), F.col("m.line").alias("match_line"))
    none = F.lit(None).cast("int")
    outside = found.where("symbol is null").select("path", "doc_id", F.lit(MODULE).alias("symbol_name"), F.lit("module").alias("symbol_kind"), F.col("line_number").alias("line_start"), F.col("line_number").alias("line_end"), none.alias("byte_start"), none.alias("byte_end"), F.col("line_number").alias("match_line_number"), F.col("line").alias("match_line"))
    out = inside.unionByName(outside)
    if not with_body:
        return out
    bodies = T.body(F.col("text"), F.col("byte_start"), F.col("byte_end"))
    return out.join(files.select("doc_id", "text"), "doc_id").withColumn("body", F.coalesce(bodies, "match_line")).drop("text")
