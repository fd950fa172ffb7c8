import hashlib

import numpy as np
import pytest

from lodestrata.llm import suffix


def slow(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(b for b, h in zip(r, hit, strict=True) if not h)
        runs = int(sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit)))
        out.append((len(r), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list("abcé "), int(rng.integers(20, 90)))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [passages[int(rng.integers(6))] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefgh "), int(rng.integers(1, 60)))) for _ in range(int(rng.integers(1, 5)))]
        texts.append("".join(parts))
    return texts + [None, "", "a" * 100, "a" * 39, texts[0], texts[0], "ab" * 60, "x" + "abc" * 30 + "yz" + "abc" * 40, "q" * 45 + "abc" * 25, "hello " * 20 + texts[1], texts[2] + "hello " * 30 + "z", "ello hello hello hello hello hello hello hello h"]


@pytest.mark.parametrize(("shard", "block"), [(1024, 1 << 20), (3, 200)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(suffix, "SHARD_REGIONS", shard)
    monkeypatch.setattr(suffix, "BLOCK", block)
    texts = corpus(shard)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in suffix.dedup(df, length=40).collect()}
    want = slow(texts, 40)
    assert sum(w[1] for w in want) > 500
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w, i
        assert hashlib.sha256(got[i].kept).hexdigest() == w[3]


def test_suffix_array_and_kasai():
    rng = np.random.default_rng(1)
    regions = ["".join(rng.choice(list("ab"), 80)).encode() for _ in range(6)]
    regions += [regions[0], regions[1][10:60] + b"x"]
    sizes = np.array([len(r) for r in regions])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(regions), np.uint8)
    left = np.repeat(starts[1:], sizes) - np.arange(len(data))
    order, group = suffix.suffix_array(data, left, 12)
    raw = data.tobytes()
    want: dict[bytes, list[int]] = {}
    for i in range(len(raw)):
        if left[i] >= 12:
            want.setdefault(raw[i : i + 12], []).append(i)
    want = {k: v for k, v in want.items() if len(v) > 1}
    assert [raw[i : i + 12] for i in order] == sorted(raw[i : i + 12] for i in order)
    assert sorted(order.tolist()) == sorted(i for v in want.values() for i in v)
    lcp = suffix.kasai(data, left, order, 1000)
    for k in range(1, len(order)):
        i, j = order[k], order[k - 1]
        n = 0
        while n < min(left[i], left[j]) and raw[i + n] == raw[j + n]:
            n += 1
        assert lcp[k] == n


def test_rows_of_one_id_and_empty(spark):
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(300))
    df = spark.createDataFrame([(1, long), (1, "short"), (None, long), (2, "x" + long[:500])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.dedup(df).collect())
    assert got == [(0, len(long), len(long)), (1, 5, 0), (1, len(long), len(long)), (2, 501, 500)]


def test_short_stretches_of_a_run_elsewhere(spark):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n))
    texts = []
    for i in range(60):
        d = int(rng.integers(2, 20))
        period = "".join(rng.choice(list("abcdefgh"), d - 1)) + "z"
        at, to = (int(x) for x in rng.integers(0, d, 2))
        texts += [text(9) + (period * 60)[at : at + 40 + d + int(rng.integers(0, 2 * d))] + text(9), text(9) + (period * 60)[to : to + 40 + i % d] + text(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df, length=40).collect()}
    assert got == dict(enumerate(slow(texts, 40)))


def test_planted_passages_of_over_50_words_go_from_400_bytes_on(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n))
    sizes = [360, 380, 399, 400, 401, 420, 700]
    texts, want = [], []
    for n in sizes:
        passage = (" " + words(n // 6))[: n - 1] + " "
        assert len(passage) == n and len(passage.split()) > 50
        for mark in "XY":
            rest = (words(90) + mark, mark + words(90))
            texts.append(passage.join(rest))
            kept = "".join(rest) if n >= 400 else texts[-1]
            want.append((len(texts[-1]), n if n >= 400 else 0, int(n >= 400), hashlib.sha256(kept.encode()).hexdigest()))
    texts += [words(200) for _ in range(10)]
    want += [(len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for t in texts[len(want) :]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df).collect()}
    assert got == dict(enumerate(want))
