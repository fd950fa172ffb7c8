"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers compared by log-likelihood ratio.

Fixed kinds, leftmost non-overlapping, failing matches dropped: assign (a keyword, = or :,
a value of 8 or more characters), access (AKIA..., 16 or more), hex (32 or more).

The method adds kind markov: tokens of LEAST or more characters of [A-Za-z0-9+/_-] that
no fixed span overlaps, with letters and digits or both cases mixed inside, whose ratio
log P(token | random) - log P(token | ordinary) is over `bits` bits a character.

The models are first-order chains over character classes, with add-one counts. They are
trained from labelled samples: strings drawn from secret alphabets by a seeded generator
(label: random), and the words in the whole texts of the documents of at most SAMPLE_ROWS
labelled ids, those with the smallest hashes, without the fixed kinds (label: ordinary).
The bound is `sample_rows`. The pairs of characters are counted in tasks; only the table
of counts comes to the driver. Without such documents, built-in identifiers alone stand
for the latter.

Defined cases: null text is as empty; rows are judged one by one, so repeated rows and
ids give repeated results; all rows of a sampled id are counted; other columns are ignored
by the report and kept by redact; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, read

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32}")
LEAST = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
SAMPLE_ROWS = 2000
#: Alphabets of secrets for the labelled random strings.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
ORDINARY = "get_user_name setHttpRequestTimeout MAX_BUFFER_SIZE internationalization com/example/service/AccountController test_reads_empty_input handleClickOutside application/octet-stream content-security-policy src/main/resources/messages_2024 DEFAULT_CONNECTION_TIMEOUT isAuthenticatedUser x86_64-unknown-linux-gnu utf8_general_ci base64EncodedString 2024-01-31T10-15-00 config/environments/production-settings row_number_over_partition AbstractSingletonProxyFactoryBean very-long-hyphenated-words-here"
_INDEX = np.full(256, 0, np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"):
    _INDEX[_c] = _i + 1
_STATES = 67


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the fixed kinds."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if HEX_LONG.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _codes(token: str) -> np.ndarray:
    return _INDEX[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]


def pairs(tokens: Iterable[str]) -> np.ndarray:
    """How often a character follows another in the tokens; state 0 stands before the first character and for any other character."""
    c = np.concatenate([[0], _codes(" ".join(tokens))])  # a space is state 0
    return np.bincount(c[:-1] * _STATES + c[1:], minlength=_STATES**2).reshape(_STATES, _STATES) * (np.arange(_STATES) > 0)


def chain(counts: np.ndarray) -> np.ndarray:
    """log2 P(next | this) with add-one counts."""
    return np.log2((counts + 1) / (counts + 1).sum(axis=1, keepdims=True))


def random_samples(n: int = 4000, seed: int = 7) -> list[str]:
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        alphabet = ALPHABETS[i % len(ALPHABETS)]
        out.append("".join(alphabet[j] for j in rng.integers(0, len(alphabet), int(rng.integers(LEAST, 64)))))
    return out


def ordinary_pairs(text: str) -> np.ndarray:
    """The pairs in the words of a text, without the fixed kinds."""
    at, clean = 0, []
    for s, e, _ in base_spans(text):
        clean.append(text[at:s])
        at = max(at, e)
    return pairs(re.findall(r"[A-Za-z0-9+/_-]{3,}", " ".join([*clean, text[at:]])))


def ratio_table(ordinary: np.ndarray | int = 0) -> np.ndarray:
    """The chains' difference: what each pair of characters adds to the ratio, in bits. ordinary: the pairs in ordinary text."""
    return chain(pairs(random_samples())) - chain(pairs(ORDINARY.split() * 20) + ordinary)


def markov_spans(text: str, taken: list[tuple[int, int, str]], table: np.ndarray, bits: float) -> list[tuple[int, int, str]]:
    """taken: the fixed spans, by start."""
    out: list[tuple[int, int, str]] = []
    next_taken, last_end = 0, 0
    for m in TOKEN.finditer(text):
        while next_taken < len(taken) and taken[next_taken][0] < m.end():
            last_end = max(last_end, taken[next_taken][1])
            next_taken += 1
        if last_end > m.start():
            continue
        t = m[0]
        if not (any(c.isdigit() for c in t) and any(c.isalpha() for c in t)) and (t.islower() or t.isupper() or t[1:].islower()):
            continue
        c = np.concatenate([[0], _codes(t)])
        if table[c[:-1], c[1:]].sum() > bits * len(t):
            out.append((m.start(), m.end(), "markov"))
    return out


def train(docs: DataFrame, labels: DataFrame | None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The ratio table from the documents of at most `sample_rows` labelled ids."""
    if labels is None:
        return ratio_table()
    ids = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("__text")).join(F.broadcast(ids), F.col("__of") == F.col("__id"), "left_semi").select("__text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((_STATES, _STATES), np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    counts += ordinary_pairs(t.as_py())
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["pair", "n"])

    counts = np.zeros(_STATES**2, np.int64)
    for r in arrow_map(texts, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most _STATES**2 rows
        counts[r.pair] = r.n
    return ratio_table(counts.reshape(_STATES, _STATES))


BITS = 0.3


def _scanner(spark, table: np.ndarray, bits: float):
    shared = spark.sparkContext.broadcast(table)

    def spans(text: str | None) -> tuple[list, list]:
        text = text or ""
        base = base_spans(text)
        every = sorted(base + markov_spans(text, base, shared.value, bits), key=lambda s: (s[0], KINDS.index(s[2])))
        return base, every

    return spans


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, table: np.ndarray, bits: float = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans: one row per document, one map without a shuffle."""
    spans = _scanner(docs.sparkSession, table, bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t.as_py()) for t in b.column(1)]
            counts = [pa.array([sum(s[2] == k for s in every) for _, every in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([listed(every) for _, every in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, table: np.ndarray, bits: float = BITS, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by [SECRET]; `length_col`, if given, becomes the new number of characters where the text changed."""
    spans = _scanner(docs.sparkSession, table, bits)
    names = docs.columns
    at, n_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def cut(text: str | None) -> str | None:
        _, every = spans(text)
        if not every:
            return text
        parts, last = [], 0
        for s, e, _ in every:
            if s >= last:
                parts += [text[last:s], "[SECRET]"]
            last = max(last, e)
        return "".join([*parts, text[last:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [cut(t) for t in texts]
            arrays = list(b.columns)
            arrays[at] = pa.array(new, pa.string())
            if n_at is not None:
                lengths = b.column(n_at).to_pylist()
                arrays[n_at] = pa.array([n if a is c else len(c) for n, a, c in zip(lengths, texts, new, strict=True)], b.column(n_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow_map(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the spans of every document."""
    docs = read(spark, sf_dir, "documents")
    return scan(docs, train(docs, read(spark, sf_dir, "labels")))
