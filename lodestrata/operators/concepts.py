"""Technologies and packages that a corpus mentions: an exact table, and a Bloom filter over it."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .manifests import dependencies

# What a lower-cased text contains, where the concept has another name.
RENAMED = {"postgres": "postgresql", "nextjs": "next.js", "rest": "rest-api"}
# What a lower-cased text contains to mention the concept.
KEYWORDS = """
redis postgres mysql mongodb sqlite dynamodb
express fastapi django flask spring actix axum gin echo nextjs react vue angular svelte
graphql grpc websocket rest
docker kubernetes terraform aws gcp azure
jest pytest vitest mocha
oauth jwt bcrypt
rabbitmq kafka celery bull
typescript python
""".split()


def keywords(text: Column) -> Column:
    """The concepts whose keyword is in the text, as an array."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(RENAMED.get(k, k))) for k in KEYWORDS]), lambda x: x.isNotNull())


def _stripped(word: Column, kept: str) -> Column:
    return F.regexp_replace(word, rf"^[^\p{{L}}\p{{N}}{kept}]+|[^\p{{L}}\p{{N}}{kept}]+$", "")


def imported_names(line: Column) -> Column:
    """The names that a line of code imports, by the forms of four languages."""
    t = F.trim(line)
    none = F.array().cast("array<string>")
    long_enough = lambda x: F.octet_length(x) >= 2
    words = F.filter(F.split(t, r"\s+"), lambda w: ~w.isin("import", "from", "as"))
    python = F.when(t.startswith("import ") | t.startswith("from "), F.filter(F.transform(words, lambda w: _stripped(w, "_-")), long_enough)).otherwise(none)
    parts = F.filter(F.transform(F.split(t, "['\"]"), F.trim), lambda x: long_enough(x) & ~F.contains(x, F.lit(" ")))
    heads = F.filter(F.transform(parts, lambda x: F.substring_index(x, "/", 1)), long_enough)
    quoted = F.contains(t, F.lit("require(")) | F.contains(t, F.lit("from '")) | F.contains(t, F.lit('from "'))
    script = F.when(quoted, F.concat(parts, heads)).otherwise(none)
    crate = _stripped(F.substring_index(F.substring(t, 5, 2**30), "::", 1), "_")
    rust = F.when(t.startswith("use ") & long_enough(crate), F.array(crate)).otherwise(none)
    bare = F.regexp_replace(t, '^"+|"+$', "")
    go = F.when(t.startswith('"') & t.endswith('"') & long_enough(bare), F.array(bare, F.substring_index(bare, "/", -1))).otherwise(none)
    return F.concat(python, script, rust, go)


def concepts(files: DataFrame) -> DataFrame:
    """doc_id, concept (lower case): keywords, imported names, file names and extensions, and what manifests depend on. One pass over the texts."""
    lines = F.split("text", "\n")
    name = T.file_name(F.col("path"))
    may_import = F.filter(lines, lambda x: x.rlike("import |from |require\\(|use |\""))
    found = F.concat(keywords(F.col("text")), F.flatten(F.transform(may_import, imported_names)), F.array(name), F.array_compact(F.array(T.extension(F.col("path")))))
    out = files.select("doc_id", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("concept"))
    manifests = dependencies(files).select("doc_id", F.lower("concept").alias("concept"))
    return out.unionByName(manifests).where("concept <> ''").distinct()


def exists(table: DataFrame, asked: DataFrame) -> DataFrame:
    """name, present of asked (name): whether it is a concept, in any case."""
    there = table.select(F.col("concept").alias("__c")).distinct()
    return asked.join(there, F.lower("name") == F.col("__c"), "left").select("name", F.col("__c").isNotNull().alias("present"))


class Bloom:
    """A Bloom filter: bits set by double hashing, any case of an item alike. No false negatives; about `share` false positives at `expected` items."""

    def __init__(self, expected: int = 10_000, share: float = 0.01):
        n = max(1, expected)
        self.bits = max(64, math.ceil(-n * math.log(share) / math.log(2) ** 2))
        self.hashes = min(16, max(1, math.ceil(self.bits / n * math.log(2))))
        self.words = bytearray(-(-self.bits // 64) * 8)
        self.insertions = 0

    @property
    def size_bytes(self) -> int:
        return len(self.words)

    @property
    def is_empty(self) -> bool:
        return self.insertions == 0

    def _hashed(self, items: DataFrame, column: str) -> DataFrame:
        """items with two hashes of the item, any case alike."""
        low = F.lower(F.col(column))
        return items.select("*", F.xxhash64(low).alias("__a"), F.xxhash64(low, F.lit(1)).alias("__b"))

    def _places(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bits of each item of a batch whose last columns are its hashes."""
        a, b = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False).astype(np.int64) % self.bits for k in (2, 1))
        return (a[:, None] + np.arange(self.hashes) * b[:, None]) % self.bits

    def add(self, items: DataFrame, column: str) -> "Bloom":
        """Set the bits of all items. Each task sends its filter's words that aren't 0; they are or-ed by word, so that at most the filter's words come to the driver."""
        bloom = Bloom.__new__(Bloom)
        bloom.bits, bloom.hashes = self.bits, self.hashes

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n = np.zeros(-(-bloom.bits // 64) * 8, np.uint8), 0
            for b in batches:
                n += b.num_rows
                at = np.unique(bloom._places(b))
                np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
            words = found.view("<i8")
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([0, *words[at].tolist()], pa.int64()), pa.array([n] + [0] * len(at), pa.int64())], names=["word", "bits", "n"])

        parts = self._hashed(items.select(column), column).select("__a", "__b").mapInArrow(run, "word int, bits long, n long")
        words = np.frombuffer(self.words, "<i8").copy()
        for r in parts.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).toLocalIterator():
            if r.word >= 0:
                words[r.word] |= r.bits
            self.insertions += r.n
        self.words = bytearray(words.tobytes())
        return self

    def might_contain(self, items: DataFrame, column: str, alias: str = "present") -> DataFrame:
        """items with `alias`; the bits are broadcast, `size_bytes` of them."""
        shared = items.sparkSession.sparkContext.broadcast(bytes(self.words))
        bloom = Bloom.__new__(Bloom)
        bloom.bits, bloom.hashes = self.bits, self.hashes

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.frombuffer(shared.value, np.uint8)
            for b in batches:
                at = bloom._places(b)
                found = (words[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.bool_())], names=[*b.schema.names[:-2], alias])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
        return self._hashed(items, column).mapInArrow(run, f"{fields}, {alias} boolean")
