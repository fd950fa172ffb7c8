import numpy as np
import pytest
import xxhash

from lodestrata.llm import simhash


def slow_fingerprint(text, k=3):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=2):
    n = len(fps)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", "  ", "One", "a b", "A b  c\td é É", "x " * 50, "The quick brown fox jumps over The Lazy dog"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_bit_slices_agree_with_popcounts():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.unique(np.array([int(x) ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4)))) for x in base for _ in range(70)], np.uint64))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if bin(int(fp[i]) ^ int(fp[j])).count("1") <= 2}
    assert set(zip(*map(np.ndarray.tolist, simhash.close_pairs(fp, None, 2)), strict=True)) == want
    half = len(fp) // 2
    got = simhash.close_pairs(fp[:half], fp[half:], 2)
    assert {(i, j + half) for i, j in zip(*map(np.ndarray.tolist, got), strict=True)} == {(i, j) for i, j in want if i < half <= j}
    got = simhash.pairs_in_groups(fp, np.zeros(len(fp)), 2)
    assert set(zip(*map(np.ndarray.tolist, got), strict=True)) == want


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(5)
    words = ["aa", "bb", "cc", "dd", "ee"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 7)))) for _ in range(150)] + [None, "", "aa", "aa"]
    long = " ".join(rng.choice(words, 400))
    texts += [long + f" tail{i}" for i in range(40)]
    rows = [(i + 1, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.clusters(df).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps)
    assert got == {i + 1: (f"{fps[i]:016x}", want[i] + 1) for i in range(len(texts))}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {w + 1 for w in want}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.clusters(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "q r s t u v"), (7, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.clusters(df).collect())
    assert got == [(0, 0), (0, 0), (7, 7), (7, 7)]


def test_one_row_of_each_component_stays(spark):
    a, b = "one two three four five six seven", "words of quite another kind stand in here"
    rows = [(4, a), (2, a), (2, a), (None, a), (None, b), (None, b), (7, ""), (8, None), (9, "x y"), (9, b + " and more of them to read")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, key int, label string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(2, a), (None, b), (7, ""), (9, "x y"), rows[-1]]))
    assert simhash.one_of_each(df.limit(0)).count() == 0
