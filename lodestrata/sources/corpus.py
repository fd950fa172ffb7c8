"""Corpora: tables of files (doc_id, path, text) from the driver's tables, and from directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document a file source/lang/id.txt."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    return d.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation a file, its turns joined by newlines."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return _turns(spark, sf_dir).groupBy("conv_id").agg(joined.alias("text")).select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def conversation_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn a symbol of its conversation, of its role's kind, over its bytes."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = _turns(spark, sf_dir).withColumn("byte_start", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    t = t.withColumn("line_start", F.coalesce(F.sum(lines + 1).over(w), F.lit(0)) + 1)
    return t.select(
        F.col("conv_id").alias("doc_id"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("turn").cast("int").alias("ord"),
        F.col("role").alias("kind"),
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("name"),
        F.col("byte_start").cast("int").alias("byte_start"),
        (F.col("byte_start") + F.octet_length("text")).cast("int").alias("byte_end"),
        F.col("line_start").cast("int").alias("line_start"),
        (F.col("line_start") + lines).cast("int").alias("line_end"),
    )


#: Letters that make a word of prose stand for a name.
NAME_LETTERS = 8


def prose_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A grammar for prose: a line whose first word has NAME_LETTERS letters or more defines it; the line's other such words are calls.

    Returns symbols (one a line) and calls (doc_id, path, caller, callee), a row a word.
    """
    lines = files.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("low", F.lower("line"))
    lines = lines.withColumn("name", F.regexp_extract("low", r"^\p{L}+", 0)).where(F.length("name") >= NAME_LETTERS)
    number = (F.col("pos") + 1).cast("int")
    symbols = lines.select("doc_id", "path", number.alias("ord"), F.lit("function").alias("kind"), "name", number.alias("line_start"), number.alias("line_end"), "line")
    words = F.regexp_extract_all("low", F.lit(r"\p{L}{" + str(NAME_LETTERS) + r",}"), F.lit(0))
    calls = lines.select("doc_id", "path", F.col("name").alias("caller"), F.explode(words).alias("callee")).where("callee <> caller")
    return symbols, calls


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, target: the links of each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")
    return pages.select(F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
