"""Results kept for several uses, and the index on disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: Bytes of a row group of texts.
FILE_GROUP = 4 << 20
TABLES = ("files", "postings", "symbols", "edges", "concepts")


def keep(df: DataFrame) -> DataFrame:
    """df, computed once: written to the session's shared checkpoint folder if there is one, else persisted."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, or one of our own on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its input has fewer splits than there are cores; a large input stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def save(tables: dict[str, DataFrame], root: str) -> str:
    """Write a snapshot of the index under root, next to older ones, and then name it the current one; returns its path. Readers of older snapshots go on undisturbed."""
    at = f"{root}/snapshot-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        if name == "postings":
            df = df.repartitionByRange("gram").sortWithinPartitions("gram", "doc_id")
        if name == "files":  # a few ids are found by the statistics of small row groups
            df.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", FILE_GROUP).parquet(f"{at}/{name}")
            continue
        df.write.parquet(f"{at}/{name}")
    spark = next(iter(tables.values())).sparkSession
    meta = spark.createDataFrame([(VERSION, at, ",".join(tables))], "version int, snapshot string, tables string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{root}/_meta")
    return at


def load(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The current snapshot's tables; None where there is none, or it is broken or of another version."""
    try:
        meta = spark.read.parquet(f"{root}/_meta").first()
        if meta is None or meta.version != VERSION:
            return None
        return {name: spark.read.parquet(f"{meta.snapshot}/{name}") for name in meta.tables.split(",")}
    except Exception:  # noqa: BLE001  whatever is wrong with it, the index can be built anew
        return None


def compare(cached: DataFrame, current: DataFrame) -> DataFrame:
    """path, state (new, changed, deleted, same) of two listings (path, size, mtime)."""
    a = cached.select("path", F.col("size").alias("size_a"), F.col("mtime").alias("mtime_a"), F.lit(True).alias("in_a"))
    b = current.select("path", F.col("size").alias("size_b"), F.col("mtime").alias("mtime_b"), F.lit(True).alias("in_b"))
    same = F.col("size_a").eqNullSafe(F.col("size_b")) & F.col("mtime_a").eqNullSafe(F.col("mtime_b"))
    state = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "deleted").when(same, "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def prune(spark: SparkSession, root: str, most: int = 2) -> None:
    """Delete all but the `most` latest snapshots under root: the current one, and those that readers may still use."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in fs.listStatus(path) if s.getPath().getName().startswith("snapshot-")]
    for s in sorted(found, key=lambda s: s.getModificationTime())[:-most]:
        fs.delete(s.getPath(), True)
