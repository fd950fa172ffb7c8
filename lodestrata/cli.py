"""python -m lodestrata PATTERN [PATH]: search a source tree.

Of several modes the first in this order holds: --stats, --model, --exists, --callers,
--callees, --impact, --layer, -s, text. --json is for --model, --exists and --layer.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import code, concepts, graph, incremental, model, prefetch, search, semantic, structure
from .plans.regex import PatternError
from .sources import directory, store


class Corpus:
    """A corpus of files with what its modes need, made when it is asked for: text modes parse nothing."""

    def __init__(self, files: DataFrame, postings: DataFrame | None = None):
        self.files = files
        self._made: dict[str, DataFrame] = {} if postings is None else {"postings": postings}
        self._file_count = 0 if postings is None else files.count()

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, index: str | None = None) -> "Corpus":
        """The files of a tree; with `index`, a folder, over the index there, brought up to the tree: only new and changed files are read."""
        if index is None:
            return cls(directory.files(spark, root).where(F.col("text").isNotNull()))
        tables = incremental.refresh(spark, index, directory.files(spark, root, texts=False).drop("text"), lambda rows: directory.read(rows, root))
        store.prune(spark, index)
        return cls(tables["files"], tables["postings"])

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = store.keep(make())
        return self._made[name]

    @property
    def postings(self) -> DataFrame:
        return self._once("postings", lambda: search.postings(self.files))

    @property
    def parsed(self) -> DataFrame:
        return self._once("parsed", lambda: code.parse(self.files))

    @property
    def symbols(self) -> DataFrame:
        return code.symbols(self.parsed)

    @property
    def calls(self) -> DataFrame:
        return self._once("calls", lambda: graph.enclosed_calls(code.calls(self.parsed), self.symbols))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: graph.edges(self.calls, self.symbols))

    @property
    def degrees(self) -> DataFrame:
        return graph.degrees(self.calls, self.symbols)

    @property
    def concepts(self) -> DataFrame:
        return self._once("concepts", lambda: concepts.concepts(self.files))

    def matches(self, pattern: str) -> DataFrame:
        """Over the candidates of an index that is there; one is not made for a single search, which costs less."""
        if "postings" in self._made:
            return search.indexed_search(self.files, self.postings, pattern, self._file_count or self.files.count())
        return search.search(self.files, pattern)

    def search(self, pattern: str) -> DataFrame:
        return self.matches(pattern).orderBy("doc_id", "line_number")

    def structural(self, pattern: str) -> DataFrame:
        """Only files with a match are parsed."""
        hit = self.files.join(self.matches(pattern).select("doc_id").distinct(), "doc_id", "left_semi")
        symbols = code.symbols(code.parse(hit))
        return structure.structural_search(hit, symbols, pattern, with_body=True).orderBy("doc_id", "match_line_number")

    def semantic(self, pattern: str, layer: int, budget: int | None) -> DataFrame:
        """Layers 0 and 2 need no graph: only files with a match are parsed for them."""
        if semantic.layer_of(layer) != 1:
            hit = self.files.join(self.matches(pattern).select("doc_id").distinct(), "doc_id", "left_semi")
            return semantic.semantic_search(hit, code.symbols(code.parse(hit)), pattern, layer, None, budget).orderBy("doc_id", "ord")
        return semantic.semantic_search(self.files, self.symbols, pattern, layer, self.edges, budget).orderBy("doc_id", "ord")

    def exists(self, name: str) -> bool:
        asked = self.files.sparkSession.createDataFrame([(name,)], "name string")
        return concepts.exists(self.concepts, asked).first().present

    def predict(self, pattern: str) -> DataFrame:
        patterns = self.files.sparkSession.createDataFrame([(pattern,)], "pattern string")
        return prefetch.predict(patterns, prefetch.first_file(self.files, pattern), self.symbols, self.edges)

    def prefetch(self, pattern: str, cache: prefetch.Cache) -> None:
        cache.fill(self.predict(pattern), {"search": lambda p: self.semantic(p, 1, 500), "callers": lambda n: graph.callers(self.edges, n), "impact": lambda n: graph.impact(self.edges, n, 3)})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    p.add_argument("pattern", nargs="?", default="")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--model", action="store_true")
    p.add_argument("--exists", metavar="NAME")
    p.add_argument("--callers", metavar="NAME")
    p.add_argument("--callees", metavar="NAME")
    p.add_argument("--impact", metavar="NAME")
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("-s", "--structural", action="store_true")
    p.add_argument("--layer", type=int)
    p.add_argument("--budget", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--index", metavar="FOLDER", help="keep an index there and search by it")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("-c", "--count", action="store_true")
    p.add_argument("-l", "--files", action="store_true")
    return p


def answer(c: Corpus, a: argparse.Namespace) -> list[str]:
    """The lines that are printed."""
    if a.stats:
        r = model.stats(c.files, c.postings, c.symbols, graph.edge_count(c.calls, c.symbols), c.concepts).first().asDict()
        return [f"{k}: {v}" for k, v in r.items()] + [f"model tokens: {model.build(c.files, c.symbols, c.degrees)['tokens']}"]
    if a.model:
        m = model.build(c.files, c.symbols, c.degrees)
        return [json.dumps({k: v for k, v in m.items() if k != "text"}) if a.json else m["text"] + f"\n~{m['tokens']} tokens"]
    if a.exists:
        there = c.exists(a.exists)
        return [json.dumps({"name": a.exists, "exists": there}) if a.json else f"{a.exists}: {'YES (likely)' if there else 'NO (definite)'}"]
    for name, find in ((a.callers, graph.callers), (a.callees, graph.callees)):
        if name:
            return [f"{r.file}: {r.name}" for r in find(c.edges, name).orderBy("file", "name").collect()]
    if a.impact:
        return [f"[{r.severity}] depth {r.depth}: {r.file}: {r.name}" for r in graph.impact(c.edges, a.impact, a.depth).orderBy("depth", "file", "name").collect()]
    if a.layer is not None:
        found = c.semantic(a.pattern, a.layer, a.budget)
        if a.json:
            return [r.json for r in semantic.to_json(found).collect()]
        return [f"{r.file}:{r.line_range.start}-{r.line_range.end} {r.kind} {r.name} ({r.tokens} tokens)" + (f"\n  {r.signature}" if r.signature else "") + (f"\n{r.body}" if r.body else "") for r in found.collect()]
    if a.structural:
        found = c.structural(a.pattern)
        if a.count:
            return [str(found.count())]
        return [f"{r.path}:{r.line_start}-{r.line_end} {r.symbol_kind} {r.symbol_name}\n{r.body}" for r in found.collect()]
    found = c.search(a.pattern)
    if a.count:
        return [str(found.count())]
    if a.files:
        return [r.path for r in search.files_with_matches(found).orderBy("doc_id").collect()]
    return [f"{r.path}:{r.line_number}:{r.line}" for r in found.collect()]


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if not (a.pattern or a.stats or a.model or a.exists or a.callers or a.callees or a.impact):
        parser().print_usage(sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lodestrata").config("spark.ui.enabled", "false").getOrCreate()
    try:
        lines = answer(Corpus.of_tree(spark, a.path, a.index), a)
    except PatternError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    for line in lines:
        print(line)
    return 0 if lines else 1
