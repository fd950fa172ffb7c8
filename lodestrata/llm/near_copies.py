"""Near copies by SimHash and exact Jaccard similarity of word shingles: fingerprints linked by bit planes (simhash.py), then prefix-filter candidates for what these miss, all verified set against set.

Shingles: lower-case A-Z, words [^\\x20\\x09-\\x0D]+, `k` words joined by a space, as a set of
64-bit hashes; fewer than k words make one shingle, none an empty set. Documents of equal
sets are one node.

Candidates: all sets are ordered alike, shingles that a sketch (sketch.py) finds in one set
only first, then by hash. Two sets of similarity `least` or more share one of the first
n - ceil(least * n) + 1 of the n shingles of each. The single ones among these meet nothing
and aren't sent, so that most documents send nothing.

Links: sets that send any have a fingerprint, the bits that over half of the set's hashes
have. Those at most RADIUS bits apart are candidates, and so are sets of equal ones; but no
radius holds for a similarity, so that the prefix filter has to find the rest. For that
each shingle's most central set, that with the smallest share of shingles of
its own, is held against all others that sent it; what both link has one label. Then
labels are one family if sets of theirs share a sent shingle and could reach `least` by
their sizes, by the shingle's places and by a bound on what they have in common, from
counts in 128 classes of hashes. Each set of a family's labels comes once to the task that
counts exactly what the family's sets have in common. Neither step gives the pairs: only
as many as join what they found, fewer than sets, however many sets are alike. A pair that
is left out is linked already, so the components are those of all similar pairs.

Defined cases: null text is as empty; of each component one row stays, the one with the
smallest id (a null id comes last), then text key, then any of equal rows; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling, sketch
from .common import arrow_map, table
from .simhash import _LOWER, components, majority
from .simhash import links as close

#: Bytes of text to a shingle, about; only the sketch's size depends on it.
SHINGLE_BYTES = 6
#: Bits that fingerprints of candidates differ in at most, and the bands that they are blocked by.
RADIUS, RADIUS_BANDS = 4, 6
#: Rows of a shingle that are held against one at once.
ROWS = 1 << 14
#: A family of more sets, or bytes of sets, is compared in chunks.
CHUNK, CHUNK_BYTES = 4096, 8 << 20


def shingles(text: str | None, k: int) -> np.ndarray:
    """The ascending hashes of a text's shingles, each once."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(joined == 32)
    n = max(1, len(words) - k + 1)
    starts = np.concatenate([[0], gaps[: n - 1] + 1])
    stops = np.append(gaps[k - 1 :], len(joined)) if len(words) > k else np.array([len(joined)])
    return np.unique(rolling.spans(joined, starts, stops))


def fewest(n: int, least: float) -> int:
    """ceil(least * n), not raised by rounding."""
    return int(np.ceil(least * n - 1e-9))


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set, as a signed long."""
    return int(np.uint64(majority(len(s), lambda at, to: s[at:to])).view(np.int64))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """a, b: pairs of nodes (node, fp) of equal fingerprints or ones at most RADIUS bits apart, as many as join all of these."""
    first = table(prints.groupBy("fp").agg(F.min("node").alias("least")), "near-prints")
    equal = prints.join(first, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = close(first.select("fp"), RADIUS, RADIUS_BANDS, join_only=True)
    near = near.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return equal.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def signature(s: np.ndarray) -> bytes:
    """How many shingles fall into each of 128 classes, 255 for as many or more: what two sets have in common is at most the sum of the smaller counts."""
    return np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=128), 255).astype(np.uint8).tobytes()


def _signatures(values: Iterable) -> np.ndarray:
    return np.frombuffer(b"".join(v if isinstance(v, bytes) else v.as_py() for v in values), np.uint8).reshape(-1, 128)


def _could(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these signatures, row by row, may be similar enough."""
    most, size = np.minimum(x, y).sum(axis=-1, dtype=np.int64), x.sum(axis=-1, dtype=np.int64) + y.sum(axis=-1, dtype=np.int64)
    full = (x == 255).any(axis=-1) | (y == 255).any(axis=-1)
    return full | (most >= least * (size - most) - 1e-6)


def links(rows: DataFrame, sets_of: Callable[[DataFrame, str], DataFrame], least: float) -> DataFrame:
    """a, b: pairs of nodes of `rows` (node, n, single, sent, sig, fp) that connect all pairs of similarity `least` or more. sets_of gives the table of (node, shingles) for a column of nodes."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.frombuffer(x.as_py(), np.int64) for x in b.column("sent")]
            times = np.array([len(x) for x in h], np.int64)
            place = [s + np.arange(len(x), dtype=np.int32) for s, x in zip(b.column("single").to_pylist(), h, strict=True)]
            if times.sum():
                of = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), times) for c in ("node", "n", "single")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), *map(pa.array, of), pa.array(np.concatenate(place).astype(np.int32))], names=["h", "node", "n", "single", "place"])

    of_node = rows.where(F.length("sent") > 0).groupBy("node").agg(F.first("n").alias("n"), F.first("single").alias("single"), F.first("sent").alias("sent"))
    sent = table(arrow_map(of_node, prefixes, "h long, node long, n int, single int, place int"), "near-sent")
    signed = table(rows.where("sig is not null").groupBy("node").agg(F.first("sig").alias("sig")), "near-signatures")
    central = F.struct((F.col("single") / F.col("n")).alias("share"), "node", "n", "place")  # a text that others were made from has least of its own
    hubs = sent.groupBy("h").agg(F.min(central).alias("of"), F.count("*").alias("times")).where("times > 1")
    hubs = hubs.select("h", F.col("of.node").alias("hub"), F.col("of.n").alias("m"), F.col("of.place").alias("hub_place"))
    hubs = table(hubs, "near-hubs")
    met = sent.join(hubs, "h")
    common = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("hub_place")) + F.least("place", "hub_place")
    could = common >= F.lit(least) * (F.col("n") + F.col("m") - common) - F.lit(1e-6)
    first = met.where("node != hub").where(could).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    found = fingerprint_links(table(rows.where("fp is not null").select("node", "fp").distinct(), "near-fingerprints"))
    first = table(first.unionByName(found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-first")

    def promising(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_signatures(batch.column(c)) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(_could(x, y, least), pa.bool_()))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        sets = sets_of(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), label)
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

        def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common >= least * (len(x) + len(y) - common) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return table(arrow_map(both, similar, "a long, b long"), label + "-verified")

    both = first.join(signed.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(signed.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    one = verified(table(arrow_map(both.select("a", "b", "x", "y"), promising, "a long, b long"), "near-1-pairs"), "near-1")
    labels = components(one)
    labels = labels.select(F.col("node").alias("__n"), "label")
    rest = met.join(labels, F.col("node") == F.col("__n"), "left").select("h", "hub", "node", "n", "place", F.coalesce("label", "node").alias("label"))
    mixed = rest.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("h")
    rest = table(rest.join(table(mixed, "near-mixed"), "h", "left_semi"), "near-rest")
    signs = rest.join(signed.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n")).drop("__n")

    def related(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def group() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda r: r[2])  # by size
            hub, node, n, place, label = np.array([r[:5] for r in held], np.int64).T
            sig = _signatures(r[5] for r in held)
            low, high = np.searchsorted(n, least * n - 1e-6), np.searchsorted(n, (n + 1e-6) / least, side="right")

            def near(i: int, now: np.ndarray) -> np.ndarray:
                j = np.arange(low[i], high[i])
                common = 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1) + np.minimum(place[i], place[j])
                j = j[(now[j] != now[i]) & (node[j] != hub[i]) & (common >= least * (n[i] + n[j] - common) - 1e-6)]
                return np.concatenate([np.zeros(0, np.int64), *(some[_could(sig[i], sig[some], least)] for some in (j[at : at + ROWS] for at in range(0, len(j), ROWS)))])

            a, b = joined(label, np.flatnonzero(node != hub), near)  # the hub's pairs are settled
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(label[a]), pa.array(label[b])], names=["a", "b"])

        for batch in batches:
            for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "hub", "node", "n", "place", "label", "sig")), strict=True):
                if h != key:
                    if len(held) > 1:
                        yield from group()
                    key, held = h, []
                held.append(row)
        if len(held) > 1:
            yield from group()

    second = table(arrow_map(signs.repartition(tasks, "h").sortWithinPartitions("h"), related, "a long, b long").distinct(), "near-second")
    family = components(second).select(F.col("node").alias("__l"), F.col("label").alias("family"))
    members = table(rest.select("node", "label").distinct().join(family, F.col("label") == F.col("__l")).select("node", "label", "family"), "near-families")
    return one.unionByName(table(within(members.join(sets_of(members.select("node"), "near-2"), "node"), least, tasks), "near-2-verified"))


def joined(label: np.ndarray, rows: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i, j that join the labels as all pairs would that near(i, labels by now) gives, one less than the labels at most. near gives rows for those of `rows`, but for the most frequent label: one of a pair of different labels isn't of it."""
    values, now, times = np.unique(label, return_inverse=True, return_counts=True)
    left, apart = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], len(values)
    for i in rows[now[rows] != times.argmax()].tolist():
        if apart == 1:
            break
        j = near(i, now)
        others, at = np.unique(now[j], return_index=True)
        at, others = at[others != now[i]], others[others != now[i]]
        if len(others):
            left.append((np.full(len(others), i), j[at]))
            now[np.isin(now, others)] = now[i]
            apart -= len(others)
    return tuple(np.concatenate(x) for x in zip(*left, strict=True))


def similar_rows(sets: list[np.ndarray], label: np.ndarray, first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of similarity `least` or more that join the labels as all such pairs would; if `first` isn't 0, only pairs of one of the first ones and another. Common shingles are counted for all sets at once."""
    size = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    _, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held_by = np.repeat(np.arange(len(sets)), size)[np.argsort(of, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(times)[:-1]])

    def near(i: int, now: np.ndarray) -> np.ndarray:
        s = of[starts[i] : starts[i + 1]]
        s = s[times[s] > 1]
        n = times[s]
        at = np.repeat(begin[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(held_by[at], minlength=len(sets))
        good = (now != now[i]) & (common >= least * (size[i] + size - common) - 1e-9)
        if first:
            good &= (np.arange(len(sets)) < first) != (i < first)
        return np.flatnonzero(good)

    return joined(label, np.arange(len(sets)), near)


def within(members: DataFrame, least: float, tasks: int) -> DataFrame:
    """a, b: pairs of nodes that connect all pairs of similarity `least` or more of one family. members: node, label, family, shingles. A large family is cut into chunks that meet pair by pair."""
    many = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("shingles")) / CHUNK_BYTES)).cast("int")
    counts = members.groupBy("family").agg(many.alias("chunks")).withColumnRenamed("family", "__f")
    met = members.join(counts, F.col("family") == F.col("__f"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = ["family", "low", "high"]
    met = met.select("family", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") > F.col("other")).alias("second"), "node", "label", "shingles")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def group() -> Iterator[pa.RecordBatch]:
            rows = sides[0] + sides[1]
            if (key[1] == key[2] or sides[0] and sides[1]) and len(rows) > 1:
                node, label = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
                a, b = similar_rows([np.frombuffer(r[2], np.uint64) for r in rows], label, len(sides[0]) if key[1] != key[2] else 0, least)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:
            for f, low, high, side, *row in zip(*(batch.column(c).to_pylist() for c in (*by, "second", "node", "label", "shingles")), strict=True):
                if (f, low, high) != key:
                    if key:
                        yield from group()
                    key, sides = (f, low, high), ([], [])
                sides[side].append(row)
        if key:
            yield from group()

    return arrow_map(met.repartition(tasks, *by).sortWithinPartitions(*by), compare, "a long, b long")


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns."""

    key = F.xxhash64(text_col)
    d = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    repeats = sketch.repeated(d.select("text"), lambda b: (x for x in (shingles(t.as_py(), k) for t in b.column("text")) if len(x)), sketch.cells_for(size // SHINGLE_BYTES))

    def summed_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column("text"):
                s = shingles(t.as_py(), k)
                shared = repeats(s)
                single = len(s) - int(shared.sum())
                sent = s[shared][: max(0, len(s) - fewest(len(s), least) + 1 - single)]
                for values, x in zip(cols, (node_of(s), len(s), single, sent.tobytes(), signature(s) if len(sent) else None, fingerprint(s) if len(sent) else None), strict=True):
                    values.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *(pa.array(x, to) for x, to in zip(cols, kinds, strict=True))], names=["id", "key", "node", "n", "single", "sent", "sig", "fp"])

    found = table(arrow_map(d, summed_up, f"id {kind}, key long, node long, n int, single int, sent binary, sig binary, fp long"), "near-rows")
    repeats.done()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    nodes = table(found.groupBy("node").agg(F.min(order).alias("least")), "near-nodes")

    def sets_of(wanted: DataFrame, label: str) -> DataFrame:
        """node, shingles of the wanted nodes, from one text each: a bit for each of their rows tells nearly all others apart."""
        rows = table(nodes.join(wanted, "node", "left_semi").select("node", F.xxhash64("least.id", "least.key").alias("h")), label + "-wanted")
        some = sketch.repeated(rows.select("h"), lambda b: iter([np.repeat(rolling.mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), 2)]), sketch.cells_for(rows.count()))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = some(rolling.mixed(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)))
                found = [shingles(t.as_py(), k) for t in b.column("text").filter(pa.array(held))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "shingles"])

        sets = arrow_map(d.select(F.xxhash64("id", "key").alias("h"), "text"), run, "node long, shingles binary")
        return table(sets.join(rows.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), label + "-sets")

    labels = components(links(found, sets_of, least)).select(F.col("node").alias("__n"), "label")
    chosen = nodes.join(labels, F.col("node") == F.col("__n"), "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("least").alias("least")).select("least.id", "least.key")
    times = found.groupBy("id", "key").agg(F.count("*").alias("times"))
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key"))
    chosen = table(chosen.select(F.col("id").alias("__id"), F.col("key").alias("__key")).join(times, same).select("__id", "__key", "times"), "near-chosen")
    of = lambda rows, how: docs.join(rows, docs[id_col].eqNullSafe(rows["__id"]) & (key == rows["__key"]), how)
    several = chosen.where("times > 1")
    alone = of(chosen.where("times = 1"), "left_semi")
    if several.isEmpty():
        return alone
    return alone.unionByName(of(several, "inner").dropDuplicates(["__id", "__key"]).select(*docs.columns))
