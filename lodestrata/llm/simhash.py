"""SimHash near-dedup by bit-sliced comparison.

Fingerprint: lower-case A-Z, words [^\\x20\\x09-\\x0D]+, shingles of `k` words with
repeats, joined by a space; a bit is 1 if over half of the shingles' XXH64 (seed 42) have
it. Fewer than k words make one shingle; none gives fingerprint 0, linked as any other.

Links: equal fingerprints are merged first. Two of the rest at most `radius` bits apart
agree on at least BANDS - radius of the BANDS bands, so that for each choice of as many bands
they meet under one key. Under a key the fingerprints are stored as 64 bit planes, a
numpy word holding one bit of 64 fingerprints; a fingerprint is held against all of them
at once, its differences summed by carry-save counters of bits, and a block is left as
soon as all of its 64 rows are beyond the radius. Keys with many fingerprints are cut into
blocks of CHUNK rows that meet pair by pair, so that no task holds more than two.

Components: labels fall to the smallest neighbour and jump through their own label, one
written table a round, until none falls.

Defined cases: null text is as empty; repeated rows and ids each get their row, ids of
equal rows count once; a null id stands for no component number and takes that of the
rows it is linked to (null if none has an id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEYS, arrow_map, one_row_each, table, text_keys

SEED = 42
BANDS = 4
CHUNK = 4096
#: Groups up to SMALL fingerprints are compared many at a time, HELD fingerprints at once.
SMALL, HELD = 64, 100_000
#: Shingles whose hashes are unpacked at once.
BLOCK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, k: int = 3) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, stops = [0, *(g + 1 for g in gaps[: len(words) - k])], [*gaps[k - 1 :], len(joined)]
    return majority(len(starts), lambda at, to: np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to], stops[at:to], strict=True)], "<u8"))


def majority(n: int, hashes: Callable[[int, int], np.ndarray]) -> int:
    """The bits that over half of n hashes have; hashes(at, to) gives some of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        ones += np.unpackbits(hashes(at, at + BLOCK).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, k: int = 3, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` and __fp, the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fp)], names=[*keep, "__fp"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(docs.select(*keep, F.col(text_col).alias("__text")), run, f"{fields}, __fp long")


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b (of a itself, i < j, if b is None) at most `radius` bits apart, by bit planes."""
    other = a if b is None else b
    blocks = (len(other) + 63) // 64
    padded = np.zeros(blocks * 64, np.uint64)
    padded[: len(other)] = other
    planes = _planes(padded)
    full = ~np.uint64(0)
    width = (radius + 1).bit_length()
    left, right = [], []
    for i, x in enumerate(a.tolist()):
        live = np.arange(i // 64 if b is None else 0, blocks)
        counters = [np.zeros(len(live), np.uint64) for _ in range(width)]
        over = np.zeros(len(live), np.uint64)
        for bit in range(64):
            carry = planes[bit, live] ^ (full if x >> bit & 1 else np.uint64(0))
            for c in counters:  # carry-save: a plane of ones is added to 64 counters at once
                c ^= carry
                carry = carry & ~c
            over |= carry  # beyond the counters
            if bit % 8 == 7:
                beyond = over | _above(counters, radius)
                stay = beyond != full
                if not stay.all():
                    live, over, counters = live[stay], over[stay], [c[stay] for c in counters]
                    if not len(live):
                        break
        if not len(live):
            continue
        near = ~(over | _above(counters, radius))
        j = (live[:, None] * 64 + np.arange(64)).ravel()[np.unpackbits(near.view(np.uint8), bitorder="little").astype(bool)]
        j = j[(j < len(other)) & ((j > i) if b is None else True)]
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near(apart: np.ndarray, radius: int) -> np.ndarray:
    """Which numbers have at most `radius` bits set: bit planes over blocks of 64 numbers, counted by carry-save, blocks left once all are beyond."""
    blocks = (len(apart) + 63) // 64
    padded = np.full(blocks * 64, ~np.uint64(0))
    padded[: len(apart)] = apart
    planes = _planes(padded)
    live, counters, over = np.arange(blocks), [np.zeros(blocks, np.uint64) for _ in range((radius + 1).bit_length())], np.zeros(blocks, np.uint64)
    for bit in range(64):
        carry = planes[bit, live]
        for c in counters:
            c ^= carry
            carry = carry & ~c
        over |= carry
        if bit % 8 == 7:
            stay = (over | _above(counters, radius)) != ~np.uint64(0)
            if not stay.all():
                live, over, counters = live[stay], over[stay], [c[stay] for c in counters]
                if not len(live):
                    break
    out = np.zeros((blocks, 64), bool)
    if len(live):
        out[live] = np.unpackbits((~(over | _above(counters, radius))).view(np.uint8), bitorder="little").reshape(-1, 64).astype(bool)
    return out.ravel()[: len(apart)]


def _planes(padded: np.ndarray) -> np.ndarray:
    """64 planes by blocks of 64 numbers: bit r of plane p of block b is bit p of number 64 b + r."""
    blocks = len(padded) // 64
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.reshape(blocks, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little").reshape(64, blocks, 8).copy().view(np.uint64)[:, :, 0]


def pairs_in_groups(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The close pairs within each of many small groups that lie one after another: row i against row i + shift, all groups at once."""
    left, right, shift = [], [], 1
    while shift < len(fp):
        at = np.flatnonzero(group[:-shift] == group[shift:])
        if not len(at):
            break
        at = at[near(fp[at] ^ fp[at + shift], radius)]
        left.append(at)
        right.append(at + shift)
        shift += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The rows whose counter is over `radius`, from the highest plane down."""
    over, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            over |= same & counters[k]
            same &= ~counters[k]
    return over


def joining(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs of rows (of n) to keep, fewer than n, so that they join what all do."""
    order = np.argsort(left, kind="stable")
    label, keep = np.arange(n), [np.zeros(0, np.int64)]
    for some in np.split(order, np.flatnonzero(np.diff(left[order])) + 1):
        if len(some):
            own = label[left[some[0]]]
            others, at = np.unique(label[right[some]], return_index=True)
            keep.append(some[at[others != own]])
            label[np.isin(label, others)] = own
    return np.concatenate(keep)


def links(fps: DataFrame, radius: int = 2, bands: int = BANDS, join_only: bool = False) -> DataFrame:
    """a, b of all pairs of different fingerprints (a column fp, distinct) at most `radius` bits apart; join_only: of groups over SMALL only as many pairs as join them."""
    if not 0 <= radius < bands:
        raise ValueError(f"the radius has to be from 0 to {bands - 1}")
    width = 64 // bands
    masks = [sum(((1 << width) - 1) << width * i for i in chosen) for chosen in combinations(range(bands), bands - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)]))
    keyed = table(fps.select("fp", keys.alias("k")).select("fp", "k.choice", "k.value"), "simhash-keys")
    counts = keyed.groupBy("choice", "value").count().where("count > 1").select(F.col("choice").alias("__c"), F.col("value").alias("__v"), F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    met = keyed.join(counts, (F.col("choice") == F.col("__c")) & (F.col("value") == F.col("__v"))).select("fp", "choice", "value", "chunks")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("choice", "value", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") > F.col("other")).alias("second"), "fp")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, sides = None, 0, ([], [])
        held_fp, held_group = [], []

        def pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def small() -> Iterator[pa.RecordBatch]:
            fp = np.array(held_fp, np.int64).view(np.uint64)
            i, j = pairs_in_groups(fp, np.array(held_group), radius)
            yield from pairs(fp[i], fp[j])

        def group_done() -> Iterator[pa.RecordBatch]:
            if key[2] == key[3] and len(sides[0]) <= SMALL:
                held_fp.extend(sides[0])
                held_group.extend([number] * len(sides[0]))
            else:
                a, b = (np.array(x, np.int64).view(np.uint64) for x in sides)
                i, j = close_pairs(a, None if key[2] == key[3] else b, radius)
                if join_only:
                    some = joining(i, j if key[2] == key[3] else j + len(a), len(a) + len(b))
                    i, j = i[some], j[some]
                yield from pairs(a[i], (a if key[2] == key[3] else b)[j])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("choice", "value", "low", "high", "second", "fp")]
            for *k, second, fp in zip(*cols, strict=True):
                if k != key:
                    if key is not None:
                        yield from group_done()
                    key, number, sides = k, number + 1, ([], [])
                    if len(held_fp) >= HELD:
                        yield from small()
                        held_fp, held_group = [], []
                sides[second].append(fp)
        if key is not None:
            yield from group_done()
            yield from small()

    by = ["choice", "value", "low", "high"]
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(met.repartition(tasks, *by).sortWithinPartitions(*by), compare, "a long, b long").distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label of all nodes in pairs (a, b of longs): the label is the smallest node that can be reached, in unsigned or any other order kept by the caller's numbers.

    Each round every node takes the smallest label around it, and its edges move to the labels.
    """
    edges = table(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-edges")
    for _ in range(most_rounds):
        # large star: each node's larger neighbours are linked to its smallest one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = table(large, "components-large")
        # small star: each node's smaller neighbours, and itself, are linked to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        small = table(small, "components-small")
        stars = small.groupBy("a").agg(F.count("*").alias("n"))
        done = small.select("b").distinct().join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and stars.where("n > 1").isEmpty()
        edges = small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def clusters(docs: DataFrame, k: int = 3, radius: int = 2, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", with_label: bool = False) -> DataFrame:
    """`keep`, fingerprint (16 hex digits) and component_id, the smallest id that links lead to; with_label, also label, a fingerprint of the component."""
    rows = table(fingerprints(docs, k, tuple(keep), text_col), "simhash-rows")
    ids = rows.groupBy("__fp").agg(F.min(F.col(id_col)).alias("least"))
    ids = table(ids, "simhash-ids")
    labels = components(links(ids.select(F.col("__fp").alias("fp")), radius))
    named = ids.join(labels, ids["__fp"] == labels["node"], "left").select("__fp", "least", F.coalesce("label", "__fp").alias("label"))
    named = table(named, "simhash-labels")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = table(named.join(smallest, "label").select(F.col("__fp").alias("__of"), "component_id", "label"), "simhash-components")
    out = rows.join(of, F.col("__fp") == F.col("__of"))
    return out.select(*keep, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id", *(["label"] if with_label else []))


def one_of_each(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: that with the smallest id (none comes last), then text key, then any of equal rows."""
    d = docs.select(F.col(id_col).alias("__id"), *(key.alias(f"__{name}") for name, key in zip(KEYS, text_keys(F.col(text_col)), strict=True)), F.col(text_col).alias("text"))
    row = ["__id", *(f"__{c}" for c in KEYS)]
    found = table(clusters(d, k, radius, tuple(row), "__id", "text", with_label=True), "simhash-clusters")
    chosen = found.groupBy("label").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), *row)).alias("least")).select("least.*").drop("none")
    times = found.groupBy(*row).agg(F.count("*").alias("times")).withColumnsRenamed({c: c[1:] for c in row})
    same = F.col("__id").eqNullSafe(F.col("_id")) & (F.col("__key") == F.col("_key")) & (F.col("__key2") == F.col("_key2"))
    return one_row_each(docs, table(chosen.join(times, same).select(*row, "times"), "simhash-chosen"), id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of every document."""
    from .common import read

    return clusters(read(spark, sf_dir, "documents"))
