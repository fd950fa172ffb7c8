"""Substring dedup over word windows: a count-min prefilter, then exact groups of the windows estimated repeated.

A window is `n` consecutive words ([^\\x20\\x09-\\x0D]+, unchanged) of one document. Each
word covered by a window whose words also start in a document with a smaller id is
removed; windows are judged on the input.

Pass 1 counts all windows in a count-min sketch (sketch.py). Pass 2 sends on only windows
whose estimate is 2 or more, as 96 bits of a digest of their words, in three steps.

1. A task makes batches of FLUSH windows. Each bucket of digests gets the batch's windows
   that fall into it, as compressed columns. Of a window that a batch has more than PACK
   times the bucket gets one line, with its smallest id; the others stay with the batch.
2. A bucket finds the smallest id of each window, and tells each batch which of its windows
   start in an earlier document, and the smallest ids of those it had kept. So a passage in
   a third of all documents is a line for each batch.
3. A batch puts that together to what each of its documents loses.

Only the documents that lose a word are shuffled with their text to be joined to that.

Defined cases: a null or empty text has no words and keeps nothing; a document of fewer
than `n` words keeps all; rows of equal id are judged alike, each by its own text, and
never remove each other's words; a null id counts as larger than any but 2**63 - 1; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling, sketch
from .common import KEYS, arrow_map, read, table, text_keys
from .removal import finish

#: Bytes of a window assumed per word when the sketch is sized; only its size depends on it.
WORD_BYTES = 7
#: Candidates that a task holds before it groups and sends them.
FLUSH = 500_000
#: Rows of one window in a batch beyond which they stay with the batch.
PACK = 3
#: Windows to a bucket, about, if all repeat.
BUCKET_WINDOWS = 4_000_000
#: Words of a text that are hashed at once.
BLOCK = 1 << 18
#: What the lines between the steps are: removed starts or windows of a bucket, kept-back windows' smallest ids, kept-back windows, a batch's documents.
_FOUND, _LEAST, _BACK, _DOCS = range(4)
#: Stands for a null id.
_LAST = 2**63 - 1


def _zip(*columns: np.ndarray) -> bytes:
    """Columns of any length as planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(part for c in columns for part in (len(c).to_bytes(8, "little"), np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes())))


def _unzip(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in map(np.dtype, kinds):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 8).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
        at += 8 + n * kind.itemsize
    return out


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


_LINE = "bucket int, batch long, kind int, data binary"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _blocks(words: list[bytes], n: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """first window, the words joined by a space, and where the windows start and stop in that."""
    for at in range(0, len(words) - n + 1, BLOCK):
        part = words[at : at + BLOCK + n - 1]
        joined = b" ".join(part)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate([[0], gaps + 1])
        stops = np.append(gaps, len(joined))
        yield at, joined, starts[: len(part) - n + 1], stops[n - 1 :]


def dedup(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_kept, kept (the words that stay, joined by a space)."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in batch.column("text"):
            for _, joined, starts, stops in _blocks(_words(text.as_py()), n):
                yield np.unique(rolling.spans(joined, starts, stops))

    repeats = sketch.repeated(d.select("text"), hashes, sketch.cells_for(size // WORD_BYTES))
    keyed = d.select("*", *text_keys(F.col("text")))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-(size // WORD_BYTES) // BUCKET_WINDOWS))

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        digests, of, pos, turn = [], [], [], 0

        def flush() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            h1, h2 = h[:, 0].copy(), h[:, 1].astype(np.uint32)
            doc, at = np.concatenate(of), np.concatenate(pos)
            ids = np.array([_LAST if d[0] is None else d[0] for d in docs], np.int64)
            order = np.lexsort((ids[doc], h2, h1))
            first = _firsts(h1[order], h2[order])
            counts = np.diff(np.append(first, len(order)))
            often = np.repeat(counts > PACK, counts)
            alone = np.sort(order[~often])
            me = (part << 20) + turn
            out = [(me % buckets, me, _DOCS, _zip(ids, np.array([d[0] is None for d in docs], np.uint8), *(np.array([d[k] for d in docs], np.int64) for k in (1, 2))))]
            for b, some in _by(h1[alone] % np.uint64(buckets), alone):
                seen, which = np.unique(doc[some], return_inverse=True)
                out.append((b, me, _FOUND, _zip(h1[some], h2[some], seen, ids[seen], which.astype(np.uint32), at[some])))
            if often.any():
                back, least = order[often], order[first[counts > PACK]]
                out.append((me % buckets, me, _BACK, _zip(h1[back], h2[back], doc[back], at[back])))
                for b, some in _by(h1[least] % np.uint64(buckets), least):
                    out.append((b, me, _LEAST, _zip(h1[some], h2[some], ids[doc[some]])))
            return _lines(out)

        part = 0
        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()
            for doc_id, text, *keys in zip(b.column("doc_id").to_pylist(), b.column("text"), *(b.column(k).to_pylist() for k in KEYS), strict=True):
                first = True
                for at, joined, starts, stops in _blocks(_words(text.as_py()), n):
                    found = np.flatnonzero(repeats(rolling.spans(joined, starts, stops)))
                    if not len(found):
                        continue
                    if first:
                        docs.append((doc_id, *keys))
                        first = False
                    digests += [xxhash.xxh3_128_digest(joined[s:e]) for s, e in zip(starts[found].tolist(), stops[found].tolist(), strict=True)]
                    of.append(np.full(len(found), len(docs) - 1, np.uint32))
                    pos.append((found + at).astype(np.int32))
                    if len(digests) >= FLUSH:
                        yield flush()
                        docs, digests, of, pos, turn, first = [], [], [], [], turn + 1, True
        if digests:
            yield flush()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's windows: which start in an earlier document, and the smallest ids of those kept back."""
        bucket, found, least = None, [], []

        def done() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*found, *least, strict=True)]
            h1, h2, ids, batch, doc, at, kept_back = cols
            order = np.lexsort((ids, h2, h1))
            first = _firsts(h1[order], h2[order])
            low = np.empty(len(order), np.int64)
            low[order] = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
            out = []
            for me, some in _by(batch, np.flatnonzero(~kept_back & (ids > low))):
                out.append((0, me, _FOUND, _zip(doc[some], at[some])))
            for me, some in _by(batch, np.flatnonzero(kept_back)):
                out.append((0, me, _LEAST, _zip(h1[some], h2[some], low[some])))
            return _lines(out)

        for rows in batches:
            through = []
            for b, me, kind, data in zip(*(rows.column(c).to_pylist() for c in ("bucket", "batch", "kind", "data")), strict=True):
                if b != bucket:
                    if found or least:
                        yield done()
                    bucket, found, least = b, [], []
                if kind == _FOUND:
                    h1, h2, seen, ids, which, at = _unzip(data, "<u8", "<u4", "<u4", "<i8", "<u4", "<i4")
                    found.append((h1, h2, ids[which], np.full(len(h1), me), seen[which], at, np.zeros(len(h1), bool)))
                elif kind == _LEAST:
                    h1, h2, ids = _unzip(data, "<u8", "<u4", "<i8")
                    least.append((h1, h2, ids, np.full(len(h1), me), np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int32), np.ones(len(h1), bool)))
                else:
                    through.append((0, me, kind, data))
            if through:
                yield _lines(through)
        if found or least:
            yield done()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the documents of a batch lose, as words [start, end) in turn."""
        batch: int | None = None
        held: dict[int, list[bytes]] = {}

        def done() -> pa.RecordBatch:
            ids, none, *keys = _unzip(held[_DOCS][0], "<i8", "u1", "<i8", "<i8")
            parts = [_unzip(x, "<u4", "<i4") for x in held.get(_FOUND, [])]
            for x in held.get(_BACK, []):
                h1, h2, doc, at = _unzip(x, "<u8", "<u4", "<u4", "<i4")
                told = [np.concatenate(c) for c in zip(*(_unzip(y, "<u8", "<u4", "<i8") for y in held[_LEAST]), strict=True)]
                here, there = _numbered(h1, h2, told[0], told[1])
                low = np.full(int(max(here.max(), there.max())) + 1, np.iinfo(np.int64).min)
                low[there] = told[2]
                if len(np.setdiff1d(here, there)):
                    raise RuntimeError("a batch of windows was made anew with others in it")
                gone = ids[doc] > low[here]
                parts.append([doc[gone], at[gone]])
            doc, at = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int32))
            order = np.lexsort((at, doc))
            rows = [(d, _runs(at[some], n)) for d, some in _by(doc[order], order)]
            which = np.array([d for d, _ in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[which], mask=none[which] == 1), *(pa.array(k[which]) for k in keys), pa.array([r for _, r in rows], pa.list_(pa.int32()))], names=["doc_id", *KEYS, "lost"])

        for rows in batches:
            for me, kind, data in zip(*(rows.column(c).to_pylist() for c in ("batch", "kind", "data")), strict=True):
                if me != batch:
                    if held:
                        yield done()
                    batch, held = me, {}
                held.setdefault(kind, []).append(data)
        if held:
            yield done()

    numbered = keyed.withColumn("part", F.spark_partition_id())
    windows = arrow_map(numbered, candidates, _LINE).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    told = arrow_map(windows, judge, _LINE).repartition(tasks, "batch").sortWithinPartitions("batch")
    lost = arrow_map(told, gather, "doc_id long, key long, key2 long, lost array<int>")
    removed = table(lost.groupBy("doc_id", *KEYS).agg(F.flatten(F.collect_set("lost")).alias("lost")), "substring-removed")

    def result(text: str | None, lost: np.ndarray | None) -> tuple:
        words = _words(text)
        left = words
        if lost is not None:  # a document may have been in several batches
            at = [0, *_joined(lost).tolist(), len(words)]
            left = [w for s, e in zip(at[::2], at[1::2], strict=True) for w in words[s:e]]
        kept = b" ".join(left)
        out = len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest()
        return (*out, kept.decode("utf-8", "surrogatepass")) if with_kept else out

    fields = (("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), *([("kept", pa.string(), "string")] if with_kept else []))
    return finish(keyed, removed, result, fields)


def _firsts(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where the groups of equal digests start."""
    return np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, np.int64)


def _by(of: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each value. of: the values by row number, or one for each of rows."""
    of = of if len(of) == len(rows) else of[rows]
    order = np.argsort(of, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0])) if len(of) else np.zeros(0, np.int64)
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(of)], strict=True) if len(of) else ():
        yield int(of[order[s]]), rows[order[s:e]]


def _numbered(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of a and b as numbers, equal ones alike."""
    h1, h2 = np.concatenate([a1, b1]), np.concatenate([a2, b2])
    order = np.lexsort((h2, h1))
    number = np.zeros(len(h1), np.int64)
    first = np.zeros(len(h1), np.int64)
    first[_firsts(h1[order], h2[order])] = 1
    number[order] = np.cumsum(first) - 1
    return number[: len(a1)], number[len(a1) :]


def _runs(starts: np.ndarray, n: int) -> np.ndarray:
    """The union of [s, s + n) for ascending starts."""
    cut = np.flatnonzero(np.diff(starts) > n)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + n], axis=1).ravel().astype(np.int32)


def _joined(runs: np.ndarray) -> np.ndarray:
    """The union of [start, end) pairs in any order, ascending."""
    order = np.argsort(runs[::2], kind="stable")
    start, end = runs[::2][order], np.maximum.accumulate(runs[1::2][order])
    cut = np.flatnonzero(start[1:] > end[:-1])
    return np.stack([start[np.concatenate([[0], cut + 1])], end[np.append(cut, len(end) - 1)]], axis=1).ravel()


def query(spark, sf_dir: str) -> DataFrame:
    """op1: windows of 13 words, one row per document."""
    return dedup(read(spark, sf_dir, "documents"), with_kept=False)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN m USING (g) WHERE doc_id > least),
k AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(w[i], ' ' ORDER BY i) FROM (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE NOT list_contains(gone, i)), '') END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
