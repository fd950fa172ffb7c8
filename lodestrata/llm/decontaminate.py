"""Benchmark decontamination: the benchmark's normalised n-grams as a broadcast hash set, against which every training window is held.

Words: A-Z become a-z, then runs of ASCII letters and digits and of any character
beyond ASCII. A window is `n` consecutive words of an item; an item of fewer words,
but at least one, is a single window.

Defined cases: a null or empty text has no words and no hits; an item without words
has no window; repeated items each count; an empty benchmark hits nothing; columns
other than those named are ignored by the report and kept by the filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, arrow_map, same_row, table, text_keys

#: Words of the benchmark beyond which the n-gram set isn't broadcast whole but in slices.
SLICE_WORDS = 2_000_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class WindowSet:
    """The windows of a slice of the benchmark, by length: arrays of word numbers, hashed for the scan and compared word by word at a hit."""

    def __init__(self, items: list[tuple], n: int):
        self.number: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple, list[str]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            size = min(n, len(ids))
            held = self.by_length.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                owners = held.setdefault(tuple(ids[i : i + size]), [])
                if item_id not in owners:
                    owners.append(item_id)
        self.hashes = {size: np.sort(_window_hash(np.array(list(held), np.uint64))) for size, held in self.by_length.items()}

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items found."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.number.get, words, _zeros()), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, held in self.by_length.items():
            if len(words) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)  # windows of known words only
            if not len(at):
                continue
            h = _window_hash(np.stack([ids[at + j] for j in range(size)], axis=1))
            there = self.hashes[size]
            at = at[there[np.minimum(np.searchsorted(there, h), len(there) - 1)] == h]
            for i in at.tolist():
                owners = held.get(tuple(ids[i : i + size].tolist()))
                if owners:
                    hit[i : i + size] = True
                    items.update(owners)
        return hit, items


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def _window_hash(ids: np.ndarray) -> np.ndarray:
    h = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        h = (h ^ ids[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in lists of at most SLICE_WORDS words (or one item), one after another: the driver holds no more than two."""
    out: list[tuple] = []
    held = 0
    for r in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        size = len(words_of(r[1]))
        if held and held + size > SLICE_WORDS:
            yield out
            out, held = [], 0
        out.append((r[0], r[1]))
        held += size
    yield out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: tuple[str, ...] = (), doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: the columns `keep`, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and `spans`, the hit words as [first, last + 1) pairs.

    The scan is one map over the documents without a shuffle. A benchmark of more than
    SLICE_WORDS words is broadcast slice by slice, with a pass over the documents for each,
    whose written results are merged per document and, for `keep`, joined to the documents.
    """
    spark = docs.sparkSession
    slices = _slices(benchmark, item_col, text_col)
    first, second = next(slices), next(slices, None)
    id_type = docs.schema[doc_col].dataType.simpleString()
    rest = [c for c in keep if c not in (doc_col, text_col)]
    plain = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"), *rest)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    report = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<string>"
    schema = report + (", text string" if text_col in keep else "") + (f", {kept}" if kept else "")
    with_text = text_col in keep

    def scanner(items: list[tuple], with_key: bool = False):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = WindowSet(shared.value, n)
            for b in batches:
                cols: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")}
                for text in b.column("text"):
                    words = words_of(text.as_py())
                    hit, found = windows.find(words)
                    row = summary(len(words), hit, found)
                    for k, v in row.items():
                        cols[k].append(v)
                arrays = [b.column("doc_id"), pa.array(cols["n_words"], pa.int64()), pa.array(cols["n_hit"], pa.int64()), pa.array(cols["n_items"], pa.int64()), pa.array(cols["items_sha256"], pa.string()), pa.array(cols["contaminated"], pa.bool_()), pa.array(cols["spans"], pa.list_(pa.int32())), pa.array(cols["items"], pa.list_(pa.string()))]
                names = ["doc_id", *cols]
                more = KEYS if with_key else [*(["text"] if with_text else []), *rest]
                yield pa.RecordBatch.from_arrays([*arrays, *(b.column(c) for c in more)], names=[*names, *more])

        return run

    if second is None:
        return arrow_map(plain, scanner(first), schema).drop("items")
    # rows of equal id and other texts stay apart; equal rows give equal results and are counted
    parts = None
    for items in chain((first, second), slices):
        with_key = plain.select("doc_id", "text", *text_keys(F.col("text")))
        part = arrow_map(with_key, scanner(items, with_key=True), f"{report}, key long, key2 long")
        part = table(part, "decontaminate-slice")
        parts = part if parts is None else parts.unionByName(part)
    slices_of = parts.groupBy("doc_id", "n_words", *KEYS).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    if not keep:
        times = plain.groupBy("doc_id", *text_keys(F.col("text"))).agg(F.count("*").alias("times"))
        times = times.withColumnsRenamed({"doc_id": "__id", "key": "__key", "key2": "__key2"})
        merged = slices_of.join(times, same_row(slices_of, times)).select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")

    def join_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                hit = np.zeros(r["n_words"], bool)
                for s, e in zip(r["spans"][::2], r["spans"][1::2], strict=True):
                    hit[s:e] = True
                rows.append({"doc_id": r["doc_id"], **summary(r["n_words"], hit, set(r["items"]))})
                if keep:
                    rows[-1] |= {k: r[k] for k in KEYS}
            if rows:
                fields = [("doc_id", b.schema.field("doc_id").type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields + ([(k, pa.int64()) for k in KEYS] if keep else [])))

    if not keep:
        return arrow_map(merged, join_up, report).drop("items")
    found = arrow_map(slices_of, join_up, f"{report}, key long, key2 long").drop("items").withColumnsRenamed({"doc_id": "__id", "key": "__key", "key2": "__key2"})
    own = plain.withColumns(dict(zip(KEYS, text_keys(F.col("text")), strict=True)))
    return own.join(found, same_row(own, found)).select("doc_id", *found.columns[1:-2], *(["text"] if with_text else []), *rest)


def summary(n_words: int, hit: np.ndarray, found: set[str]) -> dict:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    n_hit = int(hit.sum())
    return {"n_words": n_words, "n_hit": n_hit, "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest(), "contaminated": n_hit > 0, "spans": edges.tolist(), "items": sorted(x for x in found if x is not None)}


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, least_share: float = 0.0) -> DataFrame:
    """The documents whose share of hit words is at most `least_share` (0: any hit removes the document), with all their columns, whatever their names."""
    own = {c: c if c in ("doc_id", "text") else f"__own{i}" for i, c in enumerate(docs.columns)}
    found = scan(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items())), benchmark, n, keep=tuple(own.values()))
    clean = ~F.col("contaminated") | (F.col("n_hit") <= F.col("n_words") * F.lit(least_share))
    return found.where(clean).select(*(F.col(x).alias(c) for c, x in own.items()))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, text and n_removed: each document without its hit words; the other words are kept as written, with the separators that follow them."""
    found = scan(docs.select("doc_id", "text"), benchmark, n, keep=("text",))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                out.append(_without(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), b.column("n_hit")], names=["doc_id", "text", "n_removed"])

    return arrow_map(found.select("doc_id", "text", "spans", "n_hit"), cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_removed long")


def _without(text: str, spans: list[int]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw.translate(_TO_WORDS), np.uint8) != 32
    starts = np.flatnonzero(a & ~np.concatenate([[False], a[:-1]]))
    stops = np.append(starts, len(raw))
    parts, at = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        parts.append(raw[at : stops[s]])
        at = stops[e]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: hits of 10-word windows, one row per document."""
    from .common import read

    return scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bl, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
sizes AS (SELECT DISTINCT n FROM grams),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hits AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
