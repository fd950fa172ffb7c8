"""The pipeline's near-copy stage against all pairs of shingle sets."""

import numpy as np
import pytest

from lodestrata.llm import near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def slow(texts, k=5, least=0.8):
    words = [(t or "").lower().split() for t in texts]
    sets = [{" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if label[i] != label[j] and (not both or len(sets[i] & sets[j]) >= least * both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_edited_copies(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [list(rng.choice(vocabulary, int(rng.integers(4, 150)))) for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for n in range(200):
        w = list(base[n % 12 if n % 2 else n % 40])
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(len(w)))] = "edited" + str(rng.integers(9))
        texts.append(" ".join(w[: len(w) - int(rng.integers(0, 1 + len(w) // 8))]))
    texts += [texts[0].upper(), None, "", "one two", "one two"]
    want = slow(texts)
    assert 45 < len(set(want)) < len(texts) - 60
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = corpus_pipeline.one_of_each(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_one_row_of_each(spark):
    long = " ".join(f"v{i}" for i in range(80))
    rows = [(7, long), (7, long), (7, "of one id but another text"), (None, long + " end"), (None, "some other words without id here"), (9, "last words of the table are here"), (9, "last words of the table are here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in near_copies.one_of_each(df).collect()) == sorted({t for i, t in rows if t != long + " end"})
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_a_group_of_many_similar_texts(spark, monkeypatch):
    """Copies of one text, each with other words changed, of which most pairs are a little below the bound: no step makes the pairs."""
    rng = np.random.default_rng(6)
    texts = []
    for n in range(150):
        w = [f"base{i}" for i in range(1000)]
        for at in rng.choice(1000, 12 + n % 3, replace=False):
            w[at] = f"other{n}x{at}"
        texts.append(" ".join(w))
    want, made, table = slow(texts), {}, near_copies.table

    def counted(df, label):
        out = table(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(near_copies, "table", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == sorted(set(want)) and 1 < len(set(want)) < 100
    assert made["near-second"] < 4 * len(texts) and made["near-2-verified"] < len(texts)
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == sorted(set(want))


def test_similar_rows():
    rng = np.random.default_rng(8)
    for n, first in ((60, 0), (60, 25), (2, 1)):
        sets = [np.unique(rng.choice(30, int(rng.integers(1, 28))).astype(np.uint64)) for _ in range(n)]
        label = rng.integers(0, n, n)
        pairs = {(i, j) for i in range(n) for j in range(i) if not first or j < first <= i}
        same = [(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))]
        a, b = near_copies.similar_rows(sets, label, first, 0.5)
        assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} <= set(same)

        def parts(links):
            of = label.tolist()
            for i, j in links:
                of = [of[i] if x == of[j] else x for x in of]
            return {frozenset(k for k in range(n) if of[k] == x) for x in of}

        assert parts(zip(a, b, strict=True)) == parts(same) and len(a) < len(set(label.tolist()))


def test_fingerprints_link_sets(spark):
    """The stage's SimHash: fingerprints by the definition, and links that join what all close pairs do."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([base[n % 3][int(rng.integers(0, 12)) :], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for n in range(240)]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s.tolist()) > len(s)) for s in sets]
    got = [near_copies.fingerprint(s) for s in sets]
    assert [x % 2**64 for x in got] == want
    rows = spark.createDataFrame(list(enumerate(got)), "node long, fp long")
    pairs = [(r.a, r.b) for r in near_copies.fingerprint_links(rows).collect()]

    def parts(links):
        of = list(range(len(sets)))
        for i, j in links:
            of = [of[i] if x == of[j] else x for x in of]
        return {frozenset(k for k in range(len(sets)) if of[k] == x) for x in of}

    near = [(i, j) for i in range(len(sets)) for j in range(i) if (want[i] ^ want[j]).bit_count() <= near_copies.RADIUS]
    assert all((want[i] ^ want[j]).bit_count() <= near_copies.RADIUS for i, j in pairs)
    assert parts(pairs) == parts(near) and len(near) > 1000
