"""An index kept up to date: changed files replace their rows, deleted ones leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .search import postings


def merge(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """old without the rows of the ids in gone and in new, and new (the same columns, with doc_id)."""
    out = gone.select("doc_id").unionByName(new.select("doc_id")).distinct()
    return old.join(out, "doc_id", "left_anti").unionByName(new)


def update(tables: dict[str, DataFrame], changed: DataFrame, deleted: DataFrame, derive: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """The tables after `changed` (new or changed files) and `deleted` (their doc_id). Each derived table is made of the changed files alone."""
    derive = {"postings": postings} | (derive or {})
    gone = deleted.select("doc_id").unionByName(changed.select("doc_id"))
    out = {"files": merge(tables["files"], changed, deleted)}
    for name, table in tables.items():
        if name != "files":
            out[name] = table.join(gone.distinct(), "doc_id", "left_anti").unionByName(derive[name](changed)) if name in derive else table
    return out


def refresh(spark, root: str, listing: DataFrame, read: Callable[[DataFrame], DataFrame], derive=None) -> dict[str, DataFrame]:
    """The index at root, brought up to the listing (doc_id, path, size, mtime): only new and changed files are read (read: their rows with text). Without an index all are. The result is a new snapshot."""
    current = store.load(spark, root)
    if current is None:
        files = read(listing)
        tables = {"files": files, "postings": postings(files)} | {k: f(files) for k, f in (derive or {}).items()}
    else:
        state = store.compare(current["files"], listing)
        wanted = state.where(F.col("state").isin("new", "changed"))
        known = current["files"].select("path", F.col("doc_id").alias("__old"))
        base = (current["files"].agg(F.max("doc_id")).first()[0] or 0) + 1
        fresh = read(listing.join(wanted, "path", "left_semi")).join(known, "path", "left")
        ids = F.coalesce("__old", F.monotonically_increasing_id() + base)  # a path keeps its id
        changed = store.keep(fresh.withColumn("doc_id", ids).select(*current["files"].columns))
        left = state.where(F.col("state").isin("deleted", "changed"))
        tables = update(current, changed, current["files"].join(left, "path", "left_semi"), derive)
    store.save(tables, root)
    return store.load(spark, root)
