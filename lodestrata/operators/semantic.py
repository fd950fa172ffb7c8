"""Search results in layers of detail, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import keep
from .graph import neighbour_names
from .structure import matches_in_symbols


def layer_of(n: int) -> int:
    """0 and 1 are themselves, all else is 2."""
    return n if n in (0, 1) else 2


def compress(symbols: DataFrame, layer: int, edges: DataFrame | None = None) -> DataFrame:
    """symbols (path, kind, name, line_start, line_end, ord, doc_id and, from layer 1 on, body) as results: file, name, kind, line_range, signature, calls, called_by, body, tokens.

    Layer 0 says where a symbol is, 1 adds its signature and whom it calls and is called
    by, 2 has the body instead. What a layer lacks is null.
    """
    layer = layer_of(layer)
    head = F.concat(F.col("path"), F.lit(":"), F.col("line_start").cast("string"), F.lit(":"), F.col("kind"), F.lit(" "), F.col("name"))
    no_text, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    s = symbols.withColumn("calls", no_list).withColumn("called_by", no_list)
    if layer == 1 and edges is not None:
        s = symbols.join(neighbour_names(edges), "name", "left")
    sig = T.signature(F.col("body"), F.col("kind")) if layer == 1 else no_text
    s = s.withColumn("signature", sig)
    if layer == 0:
        said = head
    elif layer == 1:
        said = F.concat(head, F.lit(" sig:"), F.col("signature"), F.lit(" calls:"), T.quoted_list(F.col("calls")), F.lit(" called_by:"), T.quoted_list(F.col("called_by")))
    else:
        said = F.col("body")
    return s.select("doc_id", "ord", F.col("path").alias("file"), "name", "kind", F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("line_range"), "signature", "calls", "called_by", (F.col("body") if layer == 2 else no_text).alias("body"), T.tokens(said).alias("tokens"))


def fit_budget(results: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """The first results whose tokens together are within the budget; the first one in any case.

    A result has a token at least, unless its text is empty, so that the first budget + 1
    are all that is brought together; only if these fit, empty ones among them, are all.
    """
    first = keep(results.orderBy(*order).limit(max(0, budget) + 1))
    held = first.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    if held.n <= max(0, budget) or held.tokens > budget:
        results = first
    w = Window.orderBy(*order)
    run = results.withColumn("__sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__n", F.row_number().over(w))
    return run.where((F.col("__sum") <= budget) | (F.col("__n") == 1)).drop("__sum", "__n")


def upgrade_first(results: DataFrame, full: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """Where the budget allows it, the first result in its full form (the same columns, from layer 2)."""
    w = Window.orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = ["doc_id", "ord"]
    other = full.select(*key, F.col("body").alias("__body"), F.col("tokens").alias("__tokens"))
    r = results.join(other, key, "left").withColumn("__n", F.row_number().over(w)).withColumn("__sum", F.sum("tokens").over(whole))
    fits = (F.col("__n") == 1) & F.col("__tokens").isNotNull() & (F.col("__sum") - F.col("tokens") + F.col("__tokens") <= budget)
    return r.withColumn("body", F.when(fits, F.col("__body")).otherwise(F.col("body"))).withColumn("tokens", F.when(fits, F.col("__tokens")).otherwise(F.col("tokens"))).drop("__body", "__tokens", "__n", "__sum")


def semantic_search(files: DataFrame, symbols: DataFrame, pattern: str, layer: int, edges: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """The symbols around matching lines as results of a layer, in the order of files and of their first matching lines; lines outside of symbols are left out."""
    found = matches_in_symbols(files, symbols, pattern).where("symbol is not null")
    found = found.groupBy("doc_id", "path", F.col("symbol.byte_start").alias("byte_start"), F.col("symbol.byte_end").alias("byte_end")).agg(F.min(F.struct("line_number", "symbol")).alias("m"))
    hit = found.select("doc_id", "path", "byte_start", "byte_end", F.col("m.line_number").alias("ord"), F.col("m.symbol.kind").alias("kind"), F.col("m.symbol.name").alias("name"), F.col("m.symbol.line_start").alias("line_start"), F.col("m.symbol.line_end").alias("line_end"))
    if layer_of(layer) > 0:
        hit = hit.join(files.select("doc_id", "text"), "doc_id").withColumn("body", T.body(F.col("text"), F.col("byte_start"), F.col("byte_end"))).drop("text")
    out = compress(hit, layer, edges)
    return out if budget is None else fit_budget(out, budget, ["doc_id", "ord"])


def to_json(results: DataFrame) -> DataFrame:
    """Each result as JSON; null fields are left out."""
    return results.select(F.to_json(F.struct(*[c for c in results.columns if c not in ("doc_id", "ord")])).alias("json"))
