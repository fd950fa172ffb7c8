"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text, by language; documents whose perplexity is beyond a quantile of trusted documents' are rejected.

Symbols are bytes, grams have up to ORDER of them. Every language with trusted text has a
model; the others and null share the model of all trusted text. Models are tables as
large as their text makes them; no task and no broadcast holds one.

Training. Trusted documents are those that the labels call good and never toxic. One in
HOLD_OUT of them, by a hash of the text, is kept for the thresholds; the grams of all
others are counted per task, summed by shard, and each order's contexts and shorter grams
are joined to it by (model, context) and (model, shorter gram).

Scoring. The documents of a partition make chunks of about CHUNK_BYTES. A chunk asks, once
for each distinct gram, the shards of the model for its probability and its weight as a
context; the answers and the chunk's documents, compressed, meet by chunk, where each
document's bits are summed. A gram that was not asked for would fail the job: the rows of
a partition have to be the same when they are read again, as those of files are.

Judging. The perplexity is 2 to the mean bits of a symbol. What is judged is that mean
drawn to the held-out documents' mean by PRIOR symbols, so that short texts aren't judged
by chance. The limit of a language is the QUANTILE of its held-out documents, by a
histogram of whole bins, times SLACK + FEW / their number; a language without any takes
the loosest limit.

Defined cases: a null or empty text has no perplexity and is rejected; without trusted
documents to count, or without held-out ones, nothing is judged and all with text are
kept; repeated rows and ids are judged row by row; an id labelled twice is trusted if all
its labels agree; other columns are ignored by the report and kept by the filter; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rolling, sketch
from .common import arrow_map, read, table

#: Bytes of the longest gram; keys have room for five.
ORDER = 5
HOLD_OUT = 5
QUANTILE, SLACK, FEW = 0.95, 1.06, 0.3
PRIOR = 128
#: Bins of a bit in scores and stored probabilities.
UNIT = 1024
#: Text of a chunk, text whose grams are cut at once, grams that a task holds before they are sorted.
CHUNK_BYTES, BLOCK, HELD = 32 << 20, 1 << 20, 1_000_000
#: Entries of a model's shard.
SHARD_ENTRIES = 1 << 20
#: The model of all trusted text.
ALL = 0
_MODEL, _ORDER = 44, 40


class Model(NamedTuple):
    """names: the number of each language's model. entries: a table (shard, kind, chunk, data) of packed keys, probabilities and weights. good: the trusted ids."""

    names: dict[str, int]
    entries: DataFrame
    shards: int
    good: DataFrame


def pieces(texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """For blocks of text: the model and the row of each piece, the pieces' sizes, and the key of the longest gram that ends at each of their bytes."""
    held: list[tuple[int, int, bytes, bytes]] = []
    size = 0
    for row, (model, raw) in enumerate(texts):
        for at in range(0, len(raw), BLOCK):
            part = raw[at : at + BLOCK]
            held.append((row, model, raw[max(0, at - ORDER + 1) : at].rjust(ORDER - 1, b"\0"), part))
            size += len(part)
            if size >= BLOCK:
                yield _keys(held)
                held, size = [], 0
    if held:
        yield _keys(held)


def _keys(held: list[tuple[int, int, bytes, bytes]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(x for _, _, before, part in held for x in (before, part)), np.uint8).astype(np.uint64)
    g = a.copy()
    for j in range(1, ORDER):
        g[j:] |= a[:-j] << np.uint64(8 * j)
    sizes = np.array([len(part) for *_, part in held])
    own = np.repeat(np.tile([False, True], len(held)), np.stack([np.full(len(held), ORDER - 1), sizes], axis=1).ravel())
    model = np.repeat(np.array([m for _, m, _, _ in held], np.uint64), sizes)
    return [row for row, *_ in held], sizes, g[own] | model << np.uint64(_MODEL) | np.uint64(ORDER << _ORDER)


def shorter(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of grams of order k + 1: those without their first symbol, and those without their last, the contexts."""
    model = keys >> np.uint64(_MODEL) << np.uint64(_MODEL) | np.uint64(k << _ORDER)
    g = keys & np.uint64((1 << 8 * (k + 1)) - 1)
    return model | g & np.uint64((1 << 8 * k) - 1), model | g >> np.uint64(8)


def needed(top: np.ndarray) -> np.ndarray:
    """All keys that the probabilities of the grams `top` may need, ascending."""
    out = [top]
    for k in range(ORDER - 1, -1, -1):
        out.append(np.unique(np.concatenate(shorter(out[-1], k))))
    return np.sort(np.concatenate(out))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Neighbouring keys share a shard, so that their differences are small."""
    return (rolling.mixed(keys >> np.uint64(16)) % np.uint64(shards)).astype(np.int32)


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Ascending keys, by the planes of their differences' bytes, and 16-bit values."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(keys).to_bytes(8, "little"), gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), *(v.astype("<i2").tobytes() for v in values)]))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    gaps = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view(np.uint64).ravel()
    rest = np.frombuffer(raw, "<i2", offset=8 + 8 * n)
    return [np.cumsum(gaps, dtype=np.uint64), *(rest.reshape(-1, n) if n else [])]


def _sharded(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and where its keys stand."""
    of = shard_of(keys, shards)
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)).tolist():
        yield s, order[cut[s] : cut[s + 1]]


_ENTRY = "shard int, kind int, chunk long, data binary"


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("shard", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(HOLD_OUT)).cast("int")


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """The ids of the trusted documents, as a table; and lang and text, compressed, of those to count. A bit for each id leaves few other documents to be joined."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"), F.count(F.when(F.col("quality").isNull() | F.col("toxic").isNull(), 1)).alias("u")).where("q = 1 and t = 0 and u = 0")
    good = table(good.select(F.col("doc_id").cast("long").alias("id")), "quality-trusted-ids")
    bits = sketch.repeated(good, lambda b: iter([np.repeat(rolling.mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), 2)]), sketch.cells_for(good.count()))

    def maybe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_up = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            b = b.filter(pa.array(bits(rolling.mixed(b.column("id").to_numpy(zero_copy_only=False).view(np.uint64)))))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array([zip_up(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column("text")], pa.binary())], names=["id", "lang", "data"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    d = d.where(F.col("id").isNotNull() & (F.length("text") > 0) & (_fold(F.col("text")) != 0))
    return good, arrow_map(d, maybe, "id long, lang string, data binary").join(good, "id", "left_semi").select("lang", "data")


def counts(trust: DataFrame, names: dict[str, int], tasks: int) -> DataFrame:
    """model, g, n: how often each gram of the highest order occurs, by language and in all (model ALL)."""
    shared = trust.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        unzip = zstandard.ZstdDecompressor().decompress

        def together() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*map(np.concatenate, zip(*held, strict=True)))

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = together()
            bare = keys & np.uint64((1 << _MODEL) - 1)  # a gram's shard is the same in all models
            yield _entries([(s, 0, 0, pack(keys[at]) + n[at].astype("<i8").tobytes()) for s, at in _sharded(bare, tasks)])

        for b in batches:
            model = [shared.value.get(x, ALL) for x in b.column("lang").to_pylist()]
            for _, _, keys in pieces(zip(model, (unzip(x.as_py()) for x in b.column("data")), strict=True)):
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size >= HELD:
                    held = [together()]
                    size = len(held[0][0])
                    if 2 * size >= HELD:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> pa.RecordBatch:
            keys, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
            own = keys >> np.uint64(_MODEL) != ALL
            bare, every = _summed(keys & np.uint64((1 << _MODEL) - 1), n)
            keys, n = np.concatenate([keys[own], bare]), np.concatenate([n[own], every])
            g = keys & np.uint64((1 << 8 * ORDER) - 1)
            return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(_MODEL)).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(n)], names=["model", "g", "n"])

        for b in batches:
            for s, data in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
                if s != shard:
                    if held:
                        yield done()
                    shard, held = s, []
                held.append(_with_counts(data.as_py()))
        if held:
            yield done()

    parts = arrow_map(trust, run, _ENTRY).select("shard", "data")
    return table(arrow_map(parts.repartition(tasks, "shard").sortWithinPartitions("shard"), merge, "model int, g long, n long"), "quality-counts")


def _with_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Undo `pack(keys) + counts`: the counts, eight bytes each, follow the frame."""
    d = zstandard.ZstdDecompressor().decompressobj()
    d.decompress(data)
    n = np.frombuffer(d.unused_data, "<i8")
    return unpack(data[: len(data) - 8 * len(n)])[0], n


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n[order], first) if len(k) else n


def probabilities(c: DataFrame) -> DataFrame:
    """key, p (of a gram, interpolated, or null), weight (of a context, for what lies below it, or null). Each order is dealt by (model, context), then by (model, shorter gram)."""
    levels = [c]
    for k in range(ORDER - 1, 0, -1):  # a lower order counts the different symbols before a gram
        lower = levels[-1].groupBy("model", F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count("*").alias("n"))
        levels.append(table(lower, f"quality-n{k}"))
    levels.reverse()
    below: DataFrame | None = None
    out: DataFrame | None = None
    key = lambda k, g: F.shiftleft(F.col("model").cast("long"), _MODEL).bitwiseOR(F.lit(k << _ORDER)).bitwiseOR(g)
    for k, level in enumerate(levels, 1):
        seen = level.groupBy("model").agg(*[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)])
        y = F.col("c1") / F.greatest(F.col("c1") + 2 * F.col("c2"), F.lit(1.0))
        safe = lambda i: F.when(F.col(f"c{i}") > 0, F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"c{i + 1}") / F.col(f"c{i}")))).otherwise(F.lit(0.5))
        discounts = seen.select("model", safe(1).alias("d1"), safe(2).alias("d2"), safe(3).alias("d3"))
        own = level.join(F.broadcast(discounts), "model").withColumn("ctx", F.shiftright("g", 8))  # a row for each language is broadcast
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        follow = Window.partitionBy("model", "ctx")  # at most 256 symbols
        own = own.withColumn("off", off).withColumn("total", F.sum("n").over(follow)).withColumn("weight", F.sum("off").over(follow) / F.col("total"))
        own = table(own.select("model", "g", "ctx", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"), "weight"), f"quality-own{k}")
        if below is None:
            p = own.withColumn("p", F.col("own") + F.col("weight") / 256)
        else:
            tail = F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("tail")
            p = own.select("*", tail).join(below.select("model", F.col("g").alias("tail"), F.col("p").alias("q")), ["model", "tail"])
            p = p.withColumn("p", F.col("own") + F.col("weight") * F.col("q"))
        below = table(p.select("model", "g", "p"), f"quality-p{k}")
        rows = below.select(key(k, F.col("g")).alias("key"), "p", F.lit(None).cast("double").alias("weight"))
        rows = rows.unionByName(own.groupBy("model", "ctx").agg(F.first("weight").alias("weight")).select(key(k - 1, F.col("ctx")).alias("key"), F.lit(None).cast("double").alias("p"), "weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _packed(entries: DataFrame, shards: int) -> DataFrame:
    """The model's table: arrays of keys, and of -log2 of probability and weight in UNITs (-1: none), by shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            values = [np.nan_to_num(np.minimum(np.rint(-np.log2(b.column(c).to_numpy(zero_copy_only=False).astype(float)) * UNIT), 32767), nan=-1) for c in ("p", "weight")]
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], [v[order] for v in values]
            yield _entries([(s, 0, 0, pack(keys[at], *(v[at] for v in values))) for s, at in _sharded(keys, shards)])

    return table(arrow_map(entries, run, _ENTRY, rows=1 << 16), "quality-model")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The models of all languages; None without trusted text to count."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good, trust = trusted(docs, labels, id_col, text_col, lang_col)
    langs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang")).where("lang is not null").join(good, "id", "left_semi")
    names = {r.lang: i for i, r in enumerate(langs.select("lang").distinct().orderBy("lang").collect(), 1)}
    c = counts(trust, names, tasks)
    if c.isEmpty():
        return None
    entries = table(probabilities(c), "quality-entries")
    shards = max(tasks, -(-entries.count() // SHARD_ENTRIES))
    return Model(names, _packed(entries, shards), shards, good)


def _chunks(b: pa.RecordBatch, sizes: list[int], before: int) -> Iterator[tuple[int, int, int]]:
    """Chunk number, first row and end of the parts of a batch: a row belongs to the chunk in which its text starts."""
    starts = before + np.cumsum([0, *sizes[:-1]])
    number = starts // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), b.num_rows]
    for s, e in zip(edges, edges[1:], strict=False):
        yield int(number[s]), s, e


def _raw(b: pa.RecordBatch, text_at: int) -> list[bytes]:
    return [t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b"" for t in b.column(text_at)]


class Answers:
    """What the shards have said to a chunk."""

    def __init__(self, parts: list[list[np.ndarray]]):
        keys, p, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        self.keys, self.p, self.weight = keys[order], p[order], weight[order]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        if not (self.keys[at] == keys).all():
            raise RuntimeError("a partition of the documents had other rows when it was read again")
        return at

    def bits(self, top: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each gram, in UNITs: that of the longest known end of it, with the weights of the known contexts before."""
        out, known, g = np.zeros(len(top), np.int64), np.zeros(len(top), bool), top
        for k in range(ORDER, 0, -1):
            p = self.p[self._at(g)]
            now = ~known & (p >= 0)
            out[now] += p[now]
            known |= now
            tail, context = shorter(g, k - 1)
            out[~known] += np.maximum(self.weight[self._at(context[~known])], 0)
            g = tail
        out[~known] += 8 * UNIT
        return out


def scored(docs: DataFrame, model: Model, columns: list[Column], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """c0, c1, ... (the values of `columns`), model, n (bytes of the text) and bits (of all of them, in UNITs) of every row."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    shared, shards, width = spark.sparkContext.broadcast(model.names), model.shards, len(columns)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """The batches of this partition, cut at the ends of chunks, with the chunks' numbers."""
        before = 0
        for b in batches:
            if b.num_rows:
                first = b.column("part")[0].as_py() << 32
                sizes = [len(x) for x in _raw(b, width + 1)]
                for number, s, e in _chunks(b, sizes, before):
                    yield first + number, b.slice(s, e - s)
                before += sum(sizes)

    def models_of(b: pa.RecordBatch) -> list[int]:
        return [shared.value.get(x, ALL) for x in b.column(width).to_pylist()]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            keys = needed(np.unique(np.concatenate(held)))
            return _entries([(s, 1, chunk, pack(keys[at])) for s, at in _sharded(keys, shards)])

        for number, b in parts(batches):
            if number != chunk:
                if held:
                    yield done()
                chunk, held, size = number, [], 0
            for _, _, keys in pieces(zip(models_of(b), _raw(b, width + 1), strict=True)):
                held.append(np.unique(keys))
                size += len(held[-1])
                if size >= HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0]) // 2
        if held:
            yield done()

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table, held = None, None, []
        for b in batches:
            out = []
            for s, kind, chunk, data in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "chunk", "data")), strict=True):
                if s != shard:
                    shard, table, held = s, None, []
                if not kind:
                    held.append(unpack(data))
                    continue
                if table is None:
                    table = _joined(held)
                keys = unpack(data)[0]
                values = [np.full(len(keys), -1, np.int16)] * 2
                if len(table[0]):
                    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
                    values = [np.where(table[0][at] == keys, v[at], np.int16(-1)) for v in table[1:]]
                out.append((s, 0, chunk, pack(keys, *values)))
            if out:
                yield _entries(out)

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_up = zstandard.ZstdCompressor(level=3).compress
        for turn, (number, b) in enumerate(parts(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield _entries([(turn, 1, number, zip_up(sink.getvalue()))])

    kinds = ", ".join(f"c{i} {d.schema[f'c{i}'].dataType.simpleString()}" for i in range(width))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, answers, held = None, None, []
        unzip = zstandard.ZstdDecompressor().decompress
        for rows in batches:
            for number, kind, data in zip(*(rows.column(c) for c in ("chunk", "kind", "data")), strict=True):
                if number.as_py() != chunk:
                    chunk, answers, held = number.as_py(), None, []
                if not kind.as_py():
                    held.append(unpack(data.as_py()))
                    continue
                if answers is None and held:
                    answers, held = Answers(held), []
                for b in pa.ipc.open_stream(unzip(data.as_py())):
                    model, raw = models_of(b), _raw(b, width + 1)
                    bits = np.zeros(len(raw), np.int64)
                    for of, sizes, keys in pieces(zip(model, raw, strict=True)):
                        top, back = np.unique(keys, return_inverse=True)
                        sums = np.add.reduceat(answers.bits(top)[back], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                        np.add.at(bits, of, sums)
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(model, pa.int32()), pa.array([len(x) for x in raw], pa.int64()), pa.array(bits)], names=[*(f"c{i}" for i in range(width)), "model", "n", "bits"])

    asked = arrow_map(d, ask, _ENTRY).unionByName(model.entries)
    told = arrow_map(asked.repartition(tasks, "shard").sortWithinPartitions("shard", "kind"), answer, _ENTRY)
    both = told.unionByName(arrow_map(d, carry, _ENTRY))
    return arrow_map(both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "shard"), score, f"{kinds}, model int, n long, bits long")


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One array of keys, and of what any part says of each."""
    if not parts:
        return [np.zeros(0, np.uint64)]
    keys, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return [k[first], *(np.maximum.reduceat(v[order], first) for v in values)]


def _judged(s: DataFrame, model: Model, id_name: str, fold_name: str) -> DataFrame:
    """s with perplexity, threshold and keep. What is collected is a row for each language."""
    spark = s.sparkSession
    held = s.where((F.col(fold_name) == 0) & (F.col("n") > 0)).select(F.col(id_name).cast("long").alias("id"), "model", "n", "bits")
    held = table(held.join(model.good, "id", "left_semi").select("model", "n", "bits"), "quality-held-out")
    means = {r.model: (r.mean, r.docs) for r in held.groupBy("model").agg((F.sum("bits") / F.sum("n")).alias("mean"), F.count("*").alias("docs")).collect()}
    if not means:
        return s.select("*", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (F.col("n") > 0).alias("keep"))
    drawn = (F.col("bits") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
    of = spark.createDataFrame([(m, float(x)) for m, (x, _) in means.items()], "model int, mean double")
    bins = held.join(F.broadcast(of), "model").groupBy("model", F.floor(drawn).alias("bin")).agg(F.count("*").alias("times"))
    upto = Window.partitionBy("model").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("times").over(upto)).withColumn("of", F.sum("times").over(Window.partitionBy("model")))
    limit = {r.model: (r.bin + 1) * (SLACK + FEW / means[r.model][1]) for r in bins.where(F.col("upto") >= F.col("of") * QUANTILE).groupBy("model").agg(F.min("bin").alias("bin")).collect()}
    loosest = max(limit, key=limit.get)
    rows = [(m, float(means.get(m, means[loosest])[0]), float(limit.get(m, limit[loosest]))) for m in range(len(model.names) + 1)]
    j = s.join(F.broadcast(spark.createDataFrame(rows, "model int, mean double, most double")), "model")
    some = F.col("n") > 0
    return j.select(*s.columns, F.when(some, F.pow(F.lit(2.0), F.col("bits") / F.col("n") / UNIT)).alias("perplexity"), F.pow(F.lit(2.0), F.col("most") / UNIT).alias("threshold"), (some & (drawn <= F.col("most"))).alias("keep"))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep: one row per document."""
    if model is None:
        n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
        return docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), n.alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (n > 0).alias("keep"))
    s = table(scored(docs, model, [F.col(id_col), F.col(lang_col), _fold(F.col(text_col))], text_col, lang_col), "quality-scores")
    return _judged(s, model, "c0", "c2").select(F.col("c0").alias("doc_id"), F.col("c1").alias("lang"), F.col("n").alias("n_symbols"), "perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    if model is None:
        return docs.where(F.length(text_col) > 0)
    quoted = [f"`{c}`" for c in docs.columns]
    s = table(scored(docs, model, [*map(F.col, quoted), _fold(F.col(text_col))], text_col, lang_col), "quality-scores")
    kept = _judged(s, model, f"c{docs.columns.index(id_col)}", f"c{len(quoted)}").where("keep")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the perplexity of every document and whether it is kept."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
