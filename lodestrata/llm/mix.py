"""Mixing sources to target weights, by DataFrame functions only.

A document's size is its number of words. Each source's target is its weighted share of
all sizes, at most `most` times what the source holds; what lies above is shared again by
weight. A source is taken floor(target / size) times whole, and for the rest the
documents below a threshold of a hash are taken once more. The thresholds are found by
histograms: words by source and hash bucket give the bucket in which the budget ends, and
only that bucket is split again, so that nothing is sorted and any thread of the hash
below the threshold for one budget is below that for a larger one (the mixes are nested).

Defined cases: a null text has size 0; a null source is a source of its own, the last;
a source of size 0 has target 0; rows equal in id and text stand or fall together, others
don't, whether they have an id or not; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, table

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a level's bucket number, and levels: 4096 buckets each, 2**36 in the end.
DIGITS, LEVELS = 3, 3
#: Sources up to which the table of sources is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    """Of id and text, so that rows without an id, or of one id, are told apart."""
    row = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(row), 1, DIGITS * LEVELS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """source, source_size, target of a table (source, source_size). Sources in order of their code points, null last, take the weights in turn.

    A source stops at `most` times its size exactly when its ratio of cap to weight is
    below the level of the final sharing, so one pass over the sources by that ratio
    finds the level. The table has a row per source and no more.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = sizes.withColumn("turn", (F.row_number().over(turn) - 1) % len(weights))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("turn").cast("int") + 1))
    w = w.withColumn("cap", most * F.col("source_size").cast("double"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "turn", F.col("source").isNull(), "source")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("ratio")
    w = w.withColumn("total", F.sum(F.col("source_size").cast("double")).over(whole))
    # the level if all sources before this one are capped and the others share what is left
    w = w.withColumn("level", (F.col("total") - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("weight").over(onward))
    w = w.withColumn("level", F.max("level").over(whole))  # it rises while sources are capped and falls after
    share = F.col("weight") * F.col("level")
    return w.select("source", "source_size", F.when(share.isNull() | (F.col("cap") <= share), F.col("cap")).otherwise(share).alias("target"))


def _with_sources(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """docs with the columns of their source. A few sources are broadcast; of many, none can be hot against an even shuffle's splits by AQE."""
    right = sources.withColumnRenamed("source", "__source")
    return docs.join(F.broadcast(right) if few else right, docs["source"].eqNullSafe(right["__source"])).drop("__source")


def thresholds(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3) -> tuple[DataFrame, bool]:
    """source, source_size, target, full (whole takes), above (the hash below which a document is taken once more) of a table (source, size, h); whether the sources are few."""
    sources = table(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    few = sources.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cut = sources.withColumn("full", whole).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("above", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        cut = table(_refine(sizes, cut, level, few), f"mix-level{level}")
    return cut, few


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), _hash(F.col(id_col), F.col(text_col)).alias("h"))
    return table(d, "mix-sizes")


def _times() -> Column:
    return F.col("full") + F.when(F.col("h") < F.col("above"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words) and times (how often the mix has the document)."""
    d = _sizes(docs, id_col, text_col, source_col)
    taken = _with_sources(d, *thresholds(d, weights, most))
    return taken.select("doc_id", "size", "source", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * _times()).alias("taken"), _times().alias("times"))


def take(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix has, with all their columns and mix_times, how often (in place of a column of that name). With few sources nothing of a document's size is shuffled."""
    cut, few = thresholds(_sizes(docs, id_col, text_col, source_col), weights, most)
    cut = cut.select(F.col("source").alias("__source"), F.col("full").alias("__full"), F.col("above").alias("__above"))
    j = docs.join(F.broadcast(cut) if few else cut, docs[source_col].eqNullSafe(F.col("__source")))
    times = (F.col("__full") + F.when(_hash(F.col(id_col), F.col(text_col)) < F.col("__above"), 1).otherwise(0)).cast("long")
    kept = j.withColumn("mix_times", times).drop("__source", "__full", "__above")
    return kept.where(F.col("mix_times") > 0)


def _refine(d: DataFrame, cut: DataFrame, level: int, few: bool) -> DataFrame:
    """One level of the histograms: `above` moves to the bucket, within the bucket that starts there, in which the budget `rest` ends; rest becomes what is left for it.

    At the last level the bucket is taken whole if that comes nearer to the budget.
    """
    step = 16 ** (DIGITS * (LEVELS - level))
    span = step * 16**DIGITS
    inside = _with_sources(d.where(F.col("size") > 0), cut.select("source", "above", "rest"), few)
    inside = inside.where((F.col("rest") > 0) & (F.col("h") >= F.col("above")) & (F.col("h") < F.col("above") + span))
    buckets = inside.groupBy("source", F.floor((F.col("h") - F.col("above")) / step).cast("long").alias("b")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = buckets.withColumn("upto", F.sum("n").over(run))
    fits = F.col("upto") <= F.col("rest")
    found = run.groupBy("source").agg(
        F.max(F.when(fits, F.col("b") + 1)).alias("after"), F.min(F.when(~fits, F.col("b"))).alias("edge"), F.max(F.when(fits, F.col("upto"))).alias("had"), F.min(F.when(~fits, F.col("upto"))).alias("would")
    )
    found = found.select(F.col("source").alias("__s"), "after", "edge", "had", "would")
    j = cut.join(found, cut["source"].eqNullSafe(found["__s"]), "left").drop("__s")
    start = F.coalesce(F.col("edge"), F.col("after"), F.lit(0)) * step
    had = F.coalesce(F.col("had"), F.lit(0))
    if level == LEVELS:
        start = start + F.when(F.col("edge").isNotNull() & (F.col("would") - F.col("rest") < F.col("rest") - had), step).otherwise(0)
    return j.select("source", "source_size", "target", "full", (F.col("rest") - had).alias("rest"), (F.col("above") + start).cast("long").alias("above"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents with the words that the mix takes of each."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM s),
fill(k, level) AS (
  SELECT 0, (SELECT max(total) / sum(weight) FROM w)
  UNION ALL
  SELECT k + 1, (SELECT (max(total) - coalesce(sum(3.0 * source_size) FILTER (3.0 * source_size <= weight * level), 0)) / sum(weight) FILTER (3.0 * source_size > weight * level) FROM w)
  FROM fill WHERE k < 64 AND level IS NOT NULL),
t AS (SELECT source, source_size, least(3.0 * source_size, weight * (SELECT max(level) FROM fill)) AS target FROM w),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_times FROM t),
c AS (SELECT d.*, f.source_size, f.target, full_times, target - full_times * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * (full_times + CASE WHEN upto <= rest OR upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
