"""What a user is likely to ask next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import likely_symbol
from .search import search

MOST = 5


def _said(query_type: str, arg, confidence: float, reason: str, turn: int):
    return F.struct(F.lit(query_type).alias("query_type"), arg.alias("arg"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), F.lit(turn).alias("turn"))


def by_pattern(patterns: DataFrame) -> DataFrame:
    """pattern, query_type, arg, confidence, reason, turn: what the pattern alone suggests. turn orders equal confidences."""
    p = F.col("pattern")
    symbol = likely_symbol(p)
    bare = F.replace(F.replace(F.replace(p, F.lit("test_"), F.lit("")), F.lit("Test"), F.lit("")), F.lit("test"), F.lit(""))
    tested = (F.contains(p, F.lit("test")) | F.contains(p, F.lit("Test"))) & (F.octet_length(bare) >= 3)
    failing = F.contains(F.lower(p), F.lit("error"))
    rules = F.array(
        F.when(symbol, _said("callers", p, 0.70, "symbol search -> callers", 0)),
        F.when(symbol, _said("impact", p, 0.40, "symbol search -> impact analysis", 1)),
        F.when(tested, _said("search", bare, 0.75, "test search -> source", 1_000_000)),
        F.when(failing, _said("search", F.lit("handle"), 0.60, "error search -> handler", 1_000_001)),
        F.when(failing, _said("search", F.lit("catch"), 0.45, "error search -> catch block", 1_000_002)),
    )
    return patterns.select("pattern", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("pattern", "r.*")


def by_first_file(patterns: DataFrame, first_files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Searches for up to two callees of each symbol in the file of a pattern's first result (first_files: pattern, doc_id)."""
    s = first_files.join(symbols.select("doc_id", "ord", "name"), "doc_id").where((F.col("name") != F.col("pattern")) & (F.octet_length("name") > 2))
    names = edges.groupBy(F.col("from_name").alias("name")).agg(F.array_sort(F.collect_list("to_name")).alias("to"))
    s = s.join(names, "name").select("pattern", "ord", F.posexplode(F.slice("to", 1, 2)).alias("k", "arg")).where("arg <> pattern")
    turn = F.row_number().over(Window.partitionBy("pattern").orderBy("ord", "k")) + 1
    return s.select("pattern", F.lit("search").alias("query_type"), "arg", F.lit(0.35).alias("confidence"), F.lit("related symbol in same file").alias("reason"), turn.alias("turn"))


def best(predictions: DataFrame, most: int = MOST) -> DataFrame:
    """pattern, rank, query_type, arg, confidence, reason: the most confident ones; of equal ones the rule that comes first."""
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("confidence"), "turn"))
    return predictions.withColumn("rank", rank).where(F.col("rank") <= most).drop("turn")


def predict(patterns: DataFrame, first_files: DataFrame | None = None, symbols: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    found = by_pattern(patterns)
    if first_files is not None:
        found = found.unionByName(by_first_file(patterns, first_files, symbols, edges))
    return best(found)


def first_file(files: DataFrame, pattern: str) -> DataFrame:
    """pattern, doc_id of the first file with a match."""
    return search(files, pattern).agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select(F.lit(pattern).alias("pattern"), "doc_id")


class Cache:
    """Results of predicted queries, and how often one of them was asked for."""

    def __init__(self):
        self.held: dict[tuple[str, str], DataFrame] = {}
        self.hits = self.predictions = 0

    def get(self, query_type: str, arg: str) -> DataFrame | None:
        found = self.held.get((query_type, arg))
        self.hits += found is not None
        return found

    @property
    def hit_rate(self) -> float:
        return 100 * self.hits / self.predictions if self.predictions else 0.0

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()

    def fill(self, predictions: DataFrame, run: dict[str, Callable[[str], DataFrame]]) -> None:
        """Run the predicted queries, a handful, and keep their results. run: by query type."""
        for r in predictions.select("query_type", "arg").collect():
            self.predictions += 1
            if (r.query_type, r.arg) not in self.held and r.query_type in run:
                df = run[r.query_type](r.arg).persist()
                df.count()
                self.held[r.query_type, r.arg] = df
