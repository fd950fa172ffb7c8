"""The call graph: edges by name, callers, callees, bounded impact.

A call resolves to every definition of its name, once for each call site, so the edges are
a bag; reachability works on distinct ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import keep


def enclosed_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """doc_id, path, caller, callee of calls (doc_id, path, callee, at): the caller is the smallest symbol around the call."""
    from .structure import MODULE, enclose

    numbered = calls.select("doc_id", "path", "callee", "at").withColumn("site", F.col("at"))
    found = enclose(numbered, symbols, "at", ["doc_id", "path", "callee", "site"])
    return found.select("doc_id", "path", F.coalesce("symbol.name", F.lit(MODULE)).alias("caller"), "callee")


def edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_file, from_name, to_file, to_name: calls joined to all definitions of their name."""
    defs = symbols.select(F.col("path").alias("to_file"), F.col("name").alias("to_name"))
    c = calls.select(F.col("path").alias("from_file"), F.col("caller").alias("from_name"), "callee")
    return c.join(defs, c["callee"] == defs["to_name"]).select("from_file", "from_name", "to_file", "to_name")


def edge_count(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The size of the bag, from counts by name: no edge is made for it."""
    c = calls.groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("c"))
    d = symbols.groupBy("name").agg(F.count("*").alias("d"))
    return c.join(d, "name").agg(F.coalesce(F.sum(F.col("c") * F.col("d")), F.lit(0)).alias("edges"))


def callers(e: DataFrame, name: str) -> DataFrame:
    return e.where(F.col("to_name") == name).select(F.col("from_file").alias("file"), F.col("from_name").alias("name"))


def callees(e: DataFrame, name: str) -> DataFrame:
    return e.where(F.col("from_name") == name).select(F.col("to_file").alias("file"), F.col("to_name").alias("name"))


def severity(depth):
    return F.when(depth == 1, "WILL BREAK").when(depth == 2, "MAY BREAK").otherwise("REVIEW")


def impact(e: DataFrame, name: str, max_depth: int = 3) -> DataFrame:
    """file, name, depth, severity of what reaches a definition of `name` that is called, by at most max_depth calls; the definitions themselves aren't listed.

    A frontier goes back over the distinct edges, a semi-join and an anti-join a level, and
    stops where it is empty.
    """
    back = keep(e.select(F.struct(F.col("to_file").alias("file"), F.col("to_name").alias("name")).alias("to"), F.struct(F.col("from_file").alias("file"), F.col("from_name").alias("name")).alias("node")).distinct())
    frontier = back.where(F.col("to.name") == name).select(F.col("to").alias("node")).distinct()
    seen = keep(frontier.withColumn("depth", F.lit(0)))
    frontier = seen.select("node")
    for depth in range(1, max_depth + 1):
        step = back.join(frontier.select(F.col("node").alias("to")), "to", "left_semi").select("node").distinct()
        new = keep(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("node")
    return seen.where("depth > 0").select("node.file", "node.name", "depth", severity(F.col("depth")).alias("severity"))


def neighbour_names(e: DataFrame) -> DataFrame:
    """name, calls, called_by: by name alone, distinct and in order; null for none."""
    out = e.groupBy(F.col("from_name").alias("name")).agg(F.array_sort(F.collect_set("to_name")).alias("calls"))
    back = e.groupBy(F.col("to_name").alias("name")).agg(F.array_sort(F.collect_set("from_name")).alias("called_by"))
    return out.join(back, "name", "full_outer")


def imported_by(imports: DataFrame, target: str) -> DataFrame:
    """path of each import (path, target) of just that target."""
    return imports.where(F.col("target") == target).select("path")


def degrees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """As name_degrees() of the edges, from counts by name: no edge is made for it. calls: caller, callee."""
    c = calls.groupBy("caller", "callee").agg(F.count("*").alias("c"))
    d = symbols.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("d"))
    met = keep(c.join(d, "callee").select("caller", "callee", (F.col("c") * F.col("d")).alias("edges")))
    back = met.groupBy(F.col("callee").alias("name")).agg(F.sum("edges").alias("callers"))
    out = met.groupBy(F.col("caller").alias("name")).agg(F.sum("edges").alias("callees"))
    none = F.lit(0)
    return back.join(out, "name", "full_outer").select("name", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def name_degrees(e: DataFrame) -> DataFrame:
    """name, callers, callees: edges that end or start at the name."""
    ends = e.select(F.explode(F.array(F.struct(F.col("to_name").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_name").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.name").alias("name")).agg(F.sum("x.i").alias("callers"), F.sum("x.o").alias("callees"))
