"""What the operators share: tables in the shared folder, Arrow maps, text keys."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so that few rows keep a worker's memory small.
ARROW_ROWS = 500
#: Rows, and bytes, that Spark hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where it is unset and all run in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def table(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and outlives any executor."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what this session's operators wrote. Call it once their results have been used."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow in batches that a worker of little memory can hold: batches of many rows come in slices of `rows`. Workers outlive a task, and are to hold nothing of it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(sliced(batches))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Return freed memory, which Arrow and the C library keep for themselves, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: The columns of text_keys.
KEYS = ("key", "key2")


def text_keys(text: Column) -> list[Column]:
    """128 bits, as KEYS, that tell rows of equal id but other texts apart; equal rows share them."""
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2")]


def same_row(left: DataFrame, right: DataFrame, id_col: str = "doc_id", prefix: str = "__") -> Column:
    """That a row of left has the id and the text of a row of right, whose columns begin with `prefix`. Null ids equal each other."""
    return left[id_col].eqNullSafe(right[f"{prefix}id"]) & (left["key"] == right[f"{prefix}key"]) & (left["key2"] == right[f"{prefix}key2"])


def one_row_each(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs, with all its columns, for each of chosen (__id, __key, __key2, times: how many rows have that id and text). Few are repeated, and only those are brought together."""
    own = dict(zip(KEYS, text_keys(F.col(text_col)), strict=True))
    same = docs[id_col].eqNullSafe(chosen["__id"]) & (own["key"] == chosen["__key"]) & (own["key2"] == chosen["__key2"])
    alone = docs.join(chosen.where("times = 1"), same, "left_semi")
    several = chosen.where("times > 1")
    if several.isEmpty():
        return alone
    return alone.unionByName(docs.join(several, same).dropDuplicates(["__id", "__key", "__key2"]).select(*(F.col(f"`{c}`") for c in docs.columns)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
