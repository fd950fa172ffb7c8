"""Suffix-array dedup of byte strings: every byte covered by a string of `length` bytes that also starts anywhere else is removed.

1. Anchors. Of each `length` bytes the k-gram (GRAM bytes) with the smallest hash is an
   anchor, so equal strings have equal anchors at equal places. A count-min sketch
   (sketch.py) tells which anchors may occur twice; only what surrounds those can hold a
   repeated string.
   (Of periodic text the first two anchors and the last are enough; it is known to repeat.)
2. Regions. Around such an anchor stand all strings that contain it. Regions of equal
   bytes are counted and travel once.
3. Shards. The regions of an anchor meet in a shard. There a suffix array is built by
   Larsson-Sadakane refinement: suffixes sorted by 8 bytes, then the groups that are still
   together by the ranks 8, 16, ... bytes on; a suffix alone in its group is at its place
   and left. Kasai's common prefixes of neighbours give the strings that repeat.
4. Merging. An anchor with more than SHARD_REGIONS different regions is dealt to several
   shards. Each sends one digest of every string that it has, in sorted arrays cut by
   ranges, and binary search in those of the other shards finds what repeats across them.

Defined cases: a null or empty text has no bytes and keeps nothing; a text shorter than
`length` loses nothing; rows of equal id are judged alike, each by its own text, and count
as different places; a null id is an id like any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling, sketch
from .common import KEYS, arrow_map, read, table, text_keys
from .removal import finish

GRAM = 128
#: Bytes of text whose anchors are found at once, and bytes of a shard's suffix array.
BLOCK, SHARD_BYTES = 1 << 20, 1 << 20
SHARD_REGIONS = 1024
#: Bytes of text to an anchor, about; only the sketch's size depends on it.
ANCHOR_BYTES = 100
HOT_BROADCAST = 100_000


def _sliding(a: np.ndarray, width: int, fn) -> np.ndarray:
    """fn (minimum or maximum) of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        a = fn(a[:-size], a[size:])
        size *= 2
    return fn(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Where the anchors of texts start that lie one after another in raw, each up to its end; their hashes; and the periodic runs found. Grams across an end are none.

    In a run of period d < gram each period has an anchor. If the run holds `length` + d
    bytes, every string within it occurs again d bytes on or back, and a string that
    reaches beyond it has the run's first or last anchor at the same place as its equals.
    A string within it may also stand in a shorter stretch elsewhere, which is no run: of
    each phase one starts among the run's first d bytes, and the first anchor in it, less
    than d bytes on, is the run's first or second. So the run is given by itself, and the
    anchors between the second and the last are left out.
    """
    n = len(raw) - gram + 1
    width = length - gram + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    at = np.arange(n)
    h = rolling.spans(raw, at, at + gram)
    for e in ends.tolist():
        h[max(0, e - gram + 1) : e] = ~np.uint64(0)
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero((_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h) & (h != ~np.uint64(0)))
    h = h[chosen]
    order = np.lexsort((chosen, h))
    p = chosen[order]
    gap = np.where((h[order][1:] == h[order][:-1]) & (np.diff(p) < gram), np.diff(p), 0)
    # runs of equal gaps, of two gaps or more
    heads = np.flatnonzero((gap > 0) & (np.concatenate([[0], gap[:-1]]) != gap))
    tails = np.flatnonzero((gap > 0) & (np.concatenate([gap[1:], [0]]) != gap)) + 1
    stays, runs = np.ones(len(p), bool), []
    for i, j in zip(heads.tolist(), tails.tolist(), strict=True):
        d, first, last = int(gap[i]), int(p[i]), int(p[j])
        if j - i < 2 or last + gram - first + 2 * d < length + d:
            continue
        k = int(np.searchsorted(ends, first, side="right"))
        low, high = int(ends[k - 1]) if k else 0, int(ends[k]) if k < len(ends) else len(raw)
        start, stop = first, last + gram
        while start > low and raw[start - 1] == raw[start - 1 + d]:
            start -= 1
        while stop < high and raw[stop] == raw[stop - d]:
            stop += 1
        if stop - start >= length + d:
            runs.append((start, stop))
            stays[i + 2 : j] = False
    left = np.sort(order[stays])
    return chosen[left], h[left], runs


def _texts(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple]:
    """Blocks of texts: (row, bytes) of each; of each anchor the text's number, its place there and its hash; and the runs (text's number, start, stop). Texts shorter than `length` are left out."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def block() -> tuple:
        raw = np.frombuffer(b"".join(t for _, t in held), np.uint8)
        ends = np.cumsum([len(t) for _, t in held])
        starts = np.concatenate([[0], ends[:-1]])
        at, h, runs = anchors(raw, ends[:-1], length, gram)
        text = np.searchsorted(ends, at, side="right")
        of_run = [int(np.searchsorted(ends, s, side="right")) for s, _ in runs]
        return held, text, at - starts[text], h, [(n, s - int(starts[n]), e - int(starts[n])) for n, (s, e) in zip(of_run, runs, strict=True)]

    for row, t in enumerate(batch.column("text")):
        t = t.as_py()
        t = t.encode("utf-8", "surrogatepass") if t else b""
        if len(t) < length:
            continue
        if len(t) > BLOCK:  # in pieces: an anchor belongs to the piece in which it starts, judged with `length` bytes around it
            for at in range(0, len(t), BLOCK):
                low = max(0, at - length)
                p, h, runs = anchors(np.frombuffer(t, np.uint8)[low : at + BLOCK + length], np.zeros(0, np.int64), length, gram)
                own = (p + low >= at) & (p + low < at + BLOCK)
                yield [(row, t)], np.zeros(int(own.sum()), np.int64), p[own] + low, h[own], [(0, s + low, e + low) for s, e in runs]
            continue
        held.append((row, t))
        size += len(t)
        if size >= BLOCK:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def suffix_array(data: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """The suffixes of at least `length` bytes that begin like another one, sorted by their first `length` bytes, and the number of each one's group.

    left: the bytes from each place to the end of its region, which no suffix goes beyond.
    """
    none = np.zeros((2, 0), np.int64)
    if len(data) < length or length < 8:
        raise ValueError("strings of at least 8 bytes, and not more than the data")
    at = np.flatnonzero(left >= 8)
    key = np.zeros(len(at), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | data[at + i].astype(np.uint64)
    rank = np.full(len(data), -1, np.int64)
    at, group = _groups(at, key)
    rank[at] = group
    h = 8
    while h < length and len(at):
        step = min(h, length - h)
        more = at[left[at] >= h + step]
        more = more[rank[more + step] >= 0]
        key = rank[more] * (int(group[-1]) + 1) + rank[more + step]
        rank[at] = -1
        at, group = _groups(more, key)
        rank[at] = group
        h += step
    return np.stack([at, group]) if len(at) else none


def _groups(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of their keys, and the keys' ranks, without the keys of one place."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    alone = new & np.concatenate([new[1:], [True]]) if len(k) else new
    return at[order][~alone], (np.cumsum(new) - 1)[~alone]


def kasai(data: np.ndarray, left: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix in `order` with the one before it (0 for the first), up to `most` bytes.

    In text order a prefix is at least one shorter than that of the place before. Where both
    neighbours are one on from the neighbours of the place before it is just that; only
    the other places are compared byte by byte.
    """
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    before = np.full(len(data) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    i = np.sort(order[1:])
    j = before[i]
    limit = np.minimum(np.minimum(left[i], left[j]), most)
    follows = np.zeros(len(i), bool)
    follows[1:] = (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1) & (left[i[1:]] < left[i[:-1]]) & (left[j[1:]] < left[j[:-1]])
    first = np.flatnonzero(~follows)
    full = np.minimum(left[i[first]], left[j[first]])
    size = np.zeros(len(first), np.int64)
    live = np.arange(len(first))
    while len(live):
        n = np.minimum(full[live] - size[live], 64)
        a, b = i[first[live]] + size[live], j[first[live]] + size[live]
        span = np.arange(64)
        same = (data[np.minimum(a[:, None] + span, len(data) - 1)] == data[np.minimum(b[:, None] + span, len(data) - 1)]) & (span < n[:, None])
        run = np.where(same.all(axis=1), 64, same.argmin(axis=1))
        size[live] += run
        live = live[(run == 64) & (size[live] < full[live])]
    head = np.maximum.accumulate(np.where(~follows, np.arange(len(i)), 0))
    whole = np.zeros(len(i), np.int64)
    whole[first] = size
    at = np.zeros(len(data), np.int64)
    at[i] = np.minimum(np.maximum(whole[head] - (np.arange(len(i)) - head), 0), limit)
    lcp[1:] = at[order[1:]]
    return lcp


def repeated_in_shard(regions: list[bytes], groups: list[int], offs: list[int], length: int) -> tuple[np.ndarray, ...]:
    """Of all regions joined: where each starts, the bytes left from each place, the places that start a string which occurs again, and one of them for each string.

    Regions of one text overlap, so a string may be seen twice at one place. Two different
    places of a string have its anchor equally far from its start; so only such are
    matched, within the regions of one anchor (groups).
    """
    sizes = np.array([len(r) for r in regions])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(regions), np.uint8)
    left = np.repeat(starts[1:], sizes) - np.arange(len(data))
    order, _ = suffix_array(data, left, length)
    string = np.cumsum(kasai(data, left, order, length) < length)
    region = np.searchsorted(starts, order, side="right") - 1
    group, apart = np.array(groups)[region], order - starts[region] - np.array(offs)[region]
    by = np.lexsort((apart, group, string))
    order, string, group, apart = order[by], string[by], group[by], apart[by]
    same = np.zeros(len(order), bool)
    same[1:] = (string[1:] == string[:-1]) & (group[1:] == group[:-1]) & (apart[1:] == apart[:-1])
    hit = same.copy()
    hit[:-1] |= same[1:]
    return starts, left, np.sort(order[hit]), order[hit & ~same]


def _spans(at: np.ndarray, length: int) -> np.ndarray:
    """Ascending starts of strings as [start, end) runs, in turn."""
    if not len(at):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(at) > length)
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)] + length], axis=1).ravel()


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, kept (the bytes that stay)."""
    spark = docs.sparkSession
    gram = min(GRAM, length // 2)
    reach = length - gram
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, h, _ in _texts(batch, length, gram):
            yield h

    repeats = sketch.repeated(d.select("text"), hashes, sketch.cells_for(size // ANCHOR_BYTES))
    keyed = d.select("*", *text_keys(F.col("text")))

    def surroundings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id").to_pylist(), list(zip(*(b.column(k).to_pylist() for k in KEYS), strict=True))
            for held, text, at, h, runs in _texts(b, length, gram):
                found = np.flatnonzero(repeats(h))
                out: list[list] = [[] for _ in range(8)]
                for n, p, a in zip(text[found].tolist(), at[found].tolist(), h[found].view(np.int64).tolist(), strict=True):
                    row, raw = held[n]
                    low = max(0, p - reach)
                    region = raw[low : p + length]
                    for values, x in zip(out, (ids[row], *keys[row], low, p - low, xxhash.xxh3_128_digest(region), region, a), strict=True):
                        values.append(x)
                for n, start, stop in runs:
                    row = held[n][0]
                    for values, x in zip(out, (ids[row], *keys[row], start, stop, None, None, None), strict=True):
                        values.append(x)
                if out[0]:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["doc_id", *KEYS, "low", "off", "rd", "region", "a"])

    # a region, with its anchor `off` bytes behind `low`; or, without an anchor, a run from `low` to `off`
    found = table(arrow_map(keyed, surroundings, "doc_id long, key long, key2 long, low int, off int, rd binary, region binary, a long"), "suffix-regions")
    w = found.where("a is not null")
    g = w.groupBy("a", "rd", "off").agg(F.count("*").alias("n"), F.first("region").alias("region"))
    g = table(g, "suffix-distinct")
    hot = table(g.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > SHARD_REGIONS).select("a", F.ceil(F.col("m") / SHARD_REGIONS).cast("int").alias("shards")), "suffix-hot")
    n_hot = hot.count()
    if n_hot:
        g = g.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "a", "left")
    else:
        g = g.withColumn("shards", F.lit(None).cast("int"))
    g = g.withColumn("shard", F.coalesce(F.pmod(F.xxhash64("rd"), F.col("shards")), F.lit(0)).cast("int"))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a region's spans; kind 1: a shard's digests, for the merge."""
        key, group, held, size = None, [], [], 0

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["kind", "a", "rd", "off", "spans", "part", "strings"])

        def shard() -> Iterator[pa.RecordBatch]:
            """held: (a, rd, off, n, region, shards, shard) of whole groups."""
            regions = [r[4] for r in held]
            number = np.cumsum([i > 0 and (r[0], r[6]) != (held[i - 1][0], held[i - 1][6]) for i, r in enumerate(held)]).tolist()
            starts, left, again, one = repeated_in_shard(regions, number, [r[2] for r in held], length)
            cut = np.searchsorted(again, starts)
            rows = []
            for i, (a, rd, off, n, region, _, _) in enumerate(held):
                spans = np.array([0, len(region)]) if n > 1 else _spans(again[cut[i] : cut[i + 1]] - starts[i], length)
                if len(spans):
                    rows.append((0, a, rd, off, spans.tolist(), None, None))
            if rows:
                yield pack(rows)
            if not any(r[5] for r in held):
                return
            single = np.setdiff1d(np.flatnonzero(left >= length), again, assume_unique=True)
            data = b"".join(regions)
            strings: dict[tuple, list] = {}
            places = np.sort(np.concatenate([single, one]))
            for i, p in zip((np.searchsorted(starts, places, side="right") - 1).tolist(), places.tolist(), strict=True):
                a, rd, off, _, _, shards, k = held[i]
                if shards:
                    start = int(p - starts[i])
                    digest = xxhash.xxh3_128_digest(data[p : p + length] + (start - off).to_bytes(4, "little", signed=True))
                    strings.setdefault((a, int.from_bytes(digest[:4], "little") % shards, k), []).append(digest + rd + off.to_bytes(4, "little") + start.to_bytes(4, "little"))
            for (a, part, _), found in strings.items():
                found.sort()
                yield pack([(1, a, None, None, None, part, b"".join(found))])

        def group_done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if len(group) > 1 or group[0][5]:
                held += group
                size += sum(len(r[4]) for r in group)
                if size >= SHARD_BYTES:
                    yield from shard()
                    held, size = [], 0
            elif group[0][3] > 1:
                a, rd, off, _, region, _, _ = group[0]
                yield pack([(0, a, rd, off, [0, len(region)], None, None)])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "rd", "off", "n", "region", "shards", "shard")), strict=True):
                if (row[0], row[6]) != key:
                    if group:
                        yield from group_done()
                    key, group = (row[0], row[6]), []
                group.append(row)
        if group:
            yield from group_done()
        if held:
            yield from shard()

    schema = "kind int, a long, rd binary, off int, spans array<int>, part int, strings binary"
    solved = arrow_map(g.repartition(tasks, "a", "shard").sortWithinPartitions("a", "shard"), solve, schema)
    if n_hot:
        solved = table(solved, "suffix-solved")
        merged = solved.where("kind = 1").select("a", "part", "strings").repartition(tasks, "a", "part").sortWithinPartitions("a", "part")
        spans = solved.where("kind = 0").select("a", "rd", "off", "spans").unionByName(arrow_map(merged, _merge(length), "a long, rd binary, off int, spans array<int>"))
    else:
        spans = solved.select("a", "rd", "off", "spans")
    spans = spans.groupBy("a", "rd", "off").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    places = w.select("doc_id", *KEYS, "low", "a", "rd", "off").join(spans, ["a", "rd", "off"])
    ends = F.flatten(F.collect_set(F.transform("spans", lambda x: x + F.col("low"))))  # equal rows of one id add nothing
    whole = found.where("a is null").select("doc_id", *KEYS, F.lit(0).alias("low"), F.array("low", "off").alias("spans"))
    places = places.select("doc_id", *KEYS, "low", "spans").unionByName(whole)
    removed = table(places.groupBy("doc_id", *KEYS).agg(ends.alias("lost")), "suffix-removed")

    def result(text: str | None, lost: np.ndarray | None) -> tuple:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        kept, gone, runs = raw, 0, 0
        if lost is not None:
            cover = np.zeros(len(raw) + 1, np.int32)
            np.add.at(cover, lost[::2], 1)
            np.add.at(cover, lost[1::2], -1)
            hit = np.cumsum(cover)[:-1] > 0
            gone, runs = int(hit.sum()), int(np.count_nonzero(np.diff(np.concatenate([[False], hit]).view(np.int8)) == 1))
            kept = np.frombuffer(raw, np.uint8)[~hit].tobytes()
        return len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])

    fields = (("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), *([("kept", pa.binary(), "binary")] if with_kept else []))
    return finish(keyed, removed, result, fields)


def _merge(length: int):
    """Which strings of a hot anchor occur in several of its shards: each shard's sorted digests are looked up in the others'."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def part() -> Iterator[pa.RecordBatch]:
            row = np.dtype([("digest", "S16"), ("rd", "S16"), ("off", "<i4"), ("start", "<i4")])
            every = np.concatenate([np.frombuffer(x, row) for x in held])
            there = np.sort(every["digest"])  # each shard has a string once
            often = np.searchsorted(there, every["digest"], side="right") - np.searchsorted(there, every["digest"]) > 1
            found: dict[tuple, list[int]] = {}
            for r in every[often]:
                found.setdefault((bytes(r["rd"]).ljust(16, b"\0"), int(r["off"])), []).append(int(r["start"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array([k[0] for k in found], pa.binary()), pa.array([k[1] for k in found], pa.int32()), pa.array([_spans(np.sort(v), length).tolist() for v in found.values()], pa.list_(pa.int32()))], names=["a", "rd", "off", "spans"])

        for b in batches:
            for a, p, strings in zip(*(b.column(c).to_pylist() for c in ("a", "part", "strings")), strict=True):
                if (a, p) != key:
                    if held:
                        yield from part()
                    key, held = (a, p), []
                held.append(strings)
        if held:
            yield from part()

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """op10: strings of 400 bytes, one row per document."""
    return dedup(read(spark, sf_dir, "documents"), with_kept=False)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, 1024 * k AS base, substr(h, 2048 * k + 1, 2846) AS s FROM d, LATERAL (SELECT unnest(range(length(h) // 2048 + 1)) AS k)),
g AS (SELECT r, base + i AS p, md5(substr(s, 2 * i + 1, 800)) AS m FROM c, LATERAL (SELECT unnest(range(least(1024, length(s) // 2 - 399))) AS i)),
again AS (SELECT m FROM g GROUP BY m HAVING count(*) > 1),
starts AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM g SEMI JOIN again USING (m)),
numbered AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM starts),
spans AS (SELECT r, k, min(p) AS s, max(p) + 400 AS e FROM numbered GROUP BY r, k),
pieces AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS after FROM spans),
cut AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) AS kept FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut.r IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
