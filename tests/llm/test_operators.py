"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, html_text, knn, mix, quality, secrets, sketch, substring, suffix, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


# --- the count-min sketch


def test_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sketch, "FLUSH", 500)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 2**63, 3000), np.repeat(rng.integers(0, 2**63, 50), 2), np.repeat(rng.integers(0, 2**63, 5), 300)])
    rng.shuffle(values)
    df = spark.createDataFrame([(int(v),) for v in values], "h long").repartition(5)
    r = sketch.repeated(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 1 << 20)
    count = Counter(values.tolist())
    unique = np.array(sorted(count))
    found = dict(zip(unique.tolist(), r(unique.view(np.uint64)).tolist(), strict=True))
    assert all(found[v] for v, n in count.items() if n > 1)
    assert sum(found[v] for v, n in count.items() if n == 1) < 30
    cells = np.unique(rng.integers(0, 1 << 20, 4000))
    assert (sketch.decode(sketch.encode(cells)) == cells).all() and sketch.encode(np.zeros(0, np.int64)) == b""


# --- 1


def slow_substring(rows, n):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, math.inf), math.inf if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < (math.inf if i is None else i):
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


@pytest.mark.parametrize(("flush", "pack"), [(500_000, 2), (40, 1), (7, 100), (1, 0)])
def test_substring(spark, monkeypatch, flush, pack):
    monkeypatch.setattr(substring, "BLOCK", 16)
    monkeypatch.setattr(substring, "FLUSH", flush)
    monkeypatch.setattr(substring, "PACK", pack)
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 200)
    rng = np.random.default_rng(4)
    passages = [" ".join(rng.choice(["a", "b", "cé", "d"], 9)) for _ in range(4)]
    rows = [(i, " ".join(str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(rng.choice(["x", "y", "z", "w", "v"], 7)) for _ in range(4))) for i in range(1, 60)]
    rows += [(7, passages[0] + "\n" + passages[1]), (None, passages[0] + " q"), (None, "new " * 30), (90, None), (91, ""), (92, "short"), (93, "a b " * 12), rows[0], (94, rows[5][1]), (95, passages[2].replace(" ", " \t\n"))]
    df = spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, n_words int, key string").repartition(3)
    got = substring.dedup(df, n=5).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_substring(rows, 5)
    assert all(sha(r.kept) == r.kept_sha256 for r in got)
    assert substring.dedup(df.limit(0)).count() == 0


def test_rows_of_one_id_whose_first_keys_collide(spark, monkeypatch):
    half = lambda text: [F.lit(7).cast("long").alias("key"), common.text_keys(text)[1]]
    long = "one two three four five six seven " * 6
    rows = [(None, long), (None, "short"), (None, long + "x"), (3, "one two three four five six"), (3, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (substring, suffix):
        monkeypatch.setattr(module, "text_keys", half)
    got = substring.dedup(df, n=5).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_substring(rows, 5)
    sizes = {(r.n_bytes, r.n_removed) for r in suffix.dedup(df, length=40).collect()}
    assert (5, 0) in sizes and (4, 0) in sizes and (27, 0) in sizes and len(sizes) == 5


# --- 2


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        new = {s for s in free if w[s] * level > most * sizes[s]}
        if not new:
            return {s: float(most * sizes[s]) if s in capped else w[s] * level for s in order}
        capped |= new


def test_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 40)), f"s{int(rng.integers(3))}") for i in range(400)] + [(1000 + i, "big " * 30, "a") for i in range(600)] + [(2000, "x y", None), (2001, None, "zero"), (2002, "", "zero"), (2002, "dup dup", "s1"), (2003, "one", "\U0001f600"), (2004, "one", "￿"), (None, "no id", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = slow_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max((r.size for r in got if r.source == s), default=0)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    kept = mix.take(df)
    assert kept.columns == [*df.columns, "mix_times"]
    assert Counter((r.doc_id, r.mix_times) for r in kept.collect()) == Counter((r.doc_id, r.times) for r in got if r.times)
    assert mix.mix(df.limit(0)).count() == 0 and mix.take(df.limit(0)).count() == 0


def test_mix_tells_rows_without_an_id_apart(spark):
    rows = [(None, f"a{i} " * 10, "s") for i in range(9)] + [(1, f"b{i} " * 10, "t") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix.mix(df, weights=(1, 5)).collect()
    for source in ("s", "t"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10


def test_mix_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    want = Counter((r.doc_id, r.taken) for r in mix.mix(df).collect())
    monkeypatch.setattr(mix, "BROADCAST_SOURCES", 0)
    assert Counter((r.doc_id, r.taken) for r in mix.mix(df).collect()) == want


# --- 3


def slow_knn(rows, is_query, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(math.floor(256 * np.float64(x)) for x in v)))
    out = set()
    for i, v in set(good):
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), j) for j, u in good if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("scale", [0.3, 3e5])
def test_knn(spark, monkeypatch, scale):
    monkeypatch.setattr(knn, "CHUNK_ROWS", 16)
    monkeypatch.setattr(knn, "QUERY_ROWS", 8)
    monkeypatch.setattr(knn, "FEWEST_PIVOTS", 6)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 6)) * scale
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=6) * scale / 4]) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(80)]  # many equal vectors
    rows += [(500, None), (510, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (520, [math.nan] * 6), (530, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, rows[0][1]), (540, [0.1, -0.2]), (550, [])]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(df, F.col("id") % 10 == 0).collect()}
    assert got == slow_knn(rows, lambda i: i % 10 == 0, 5)
    few = df.where("vec_id < 3")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(few, F.col("id") == 0).collect()} == slow_knn(rows[:3], lambda i: i == 0, 5)
    assert knn.top_k(df.limit(0), F.col("id") == 0).count() == 0


def test_knn_with_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(70, [1e8, 0.0, 0.0, 0.0]), (71, [0.0, -9e6, 1.0, 0.0]), (72, [1e8, 1e8, -1e8, 0.0]), (80, [1e300, 0.0, 0.0, 0.0]), (90, [1e308, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    end = 2**63 - 1
    want = set()
    vecs = {i: [math.floor(256 * max(-(2.0**500) / 256, min(2.0**500 / 256, x))) for x in v] for i, v in rows}
    for i, v in vecs.items():
        if i % 10 == 0:
            best = sorted((-max(-end, min(end, sum(a * b for a, b in zip(v, u, strict=True)))), j) for j, u in vecs.items() if j != i)[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(df, F.col("id") % 10 == 0).collect()} == want


# --- 4


def test_secret_patterns():
    text = 'x PassWord = "abcd1234efgh" apikey:short token=secret=abcdefghij AKIAABCDEFGHIJKL AKIA1 ' + "é" + "0123456789abcdef" * 2 + ' API_KEY: "' + "f" * 40 + '"'
    got = secrets.base_spans(text)
    want = []
    for m in re.finditer(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            want.append((m.start(), m.end(), "assign"))
    want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert got == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[2]))) and {k for _, _, k in got} == {"assign", "access", "hex"}
    assert secrets.base_spans("ſecret=abcdefghij") == []  # only ASCII letters in either case


def test_secret_models_tell_random_strings_from_names(spark):
    table = secrets.ratio_table(secrets.ordinary_pairs("the quick brown foxes are jumping over lazydogsandcats " * 5))
    unseen = secrets.random_samples(400, seed=99)
    assert np.mean([bool(secrets.markov_spans(x, [], table, secrets.BITS)) for x in unseen]) > 0.97
    names = "compute_average_temperature readConfigurationFile2 org/acme/project/module/ClassName2 kebab-case-identifier-number-2 DEFAULT_RETRY_COUNT_10 serializeObjectToStream2"
    assert secrets.markov_spans(names, [], table, secrets.BITS) == []
    rows = [(1, "key " + unseen[7] + " end"), (1, "key " + unseen[7] + " end"), (2, None), (3, ""), (None, "token = abcdefgh12")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long")
    got = secrets.scan(df, table).collect()
    assert len(got) == 5 and [r.n_markov for r in got] == [1, 1, 0, 0, 0] and got[0].spans == f"markov:4:{4 + len(unseen[7])}"
    assert got[4].spans == "assign:0:18" and got[2].base_sha256 == sha("")
    clean = secrets.redact(df, table, length_col="n_chars").collect()
    assert clean[0].text == "key [SECRET] end" and clean[0].n_chars == 16 and clean[2].text is None and clean[4].text == "[SECRET]" and clean[3].n_chars == 0
    assert secrets.scan(df.limit(0), secrets.train(df.limit(0), None)).count() == 0


def test_secret_training_and_long_texts(spark):
    """Whole texts are counted, and the chain is that of counting pair by pair."""
    rows = [(1, "plain words " * 900 + "zqzq_end"), (1, "another row of the id"), (2, None), (3, "not labelled well"), (4, 'token = "abcdefgh1234" after'), (None, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, quality int").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (None, 1), (1, 1)], "doc_id long, quality int")
    counts = np.ones((secrets._STATES, secrets._STATES))
    for w in secrets.ORDINARY.split() * 20 + ["plain", "words"] * 900 + ["zqzq_end"] + "another row the after".split():
        c = [0, *(secrets._INDEX[ord(x)] for x in w)]
        for a, b in zip(c, c[1:]):
            counts[a, b] += 1
    ordinary = np.log2(counts / counts.sum(axis=1, keepdims=True))
    assert np.allclose(secrets.train(docs, labels), secrets.chain(secrets.pairs(secrets.random_samples())) - ordinary)
    assert np.allclose(secrets.train(docs, labels.limit(0)), secrets.ratio_table())
    table = secrets.ratio_table()
    one = secrets.random_samples(7, seed=3)[2]
    text = f"password: hunter2hunter2 {one} é " * 20_000
    began = time.perf_counter()
    base = secrets.base_spans(text)
    found = secrets.markov_spans(text, base, table, secrets.BITS)
    assert time.perf_counter() - began < 10 and len(base) == 20_000
    for s, e, _ in found[:50] + found[-50:]:  # the spans of the whole text, token by token
        assert text[s:e] == one and not any(a < e and s < b for a, b, _ in base)
    assert len(found) == 20_000


# --- 5


def test_html(spark):
    assert html_text.main_text("<body><nav><a href=x>Home</a></nav><article><h1>T&amp;C</h1><p>one<b>two</b>\n three<br>four<script>no('</p>')</script></article><div class='reader-comments'><p>nice</p></div><footer>f</footer>") == "T&C onetwo three four"
    df = spark.createDataFrame([(1, "u", None, 9), (2, None, "", 9), (2, None, "", 9), (None, "u", "<p>a&nbsp; b", 9)], "page_id long, url string, html string, n_chars int")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()] == [(1, "", 0), (2, "", 0), (2, "", 0), (None, "a b", 3)]
    assert html_text.extract(df.limit(0)).count() == 0


# --- 6


def slow_decontaminate(rows, items, n):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in rows:
        w, hit, found = tok(t), set(), set()
        for k, b in items:
            v = tok(b)
            size = min(n, len(v))
            for j in range(len(v) - size + 1 if v else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == v[j : j + size]:
                        hit |= set(range(at, at + size))
                        found.add(str(k))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("slice_words", [10**6, 12])
def test_decontamination(spark, monkeypatch, slice_words):
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", slice_words)
    items = [(1, "The quick-brown fox jumps"), (2, "ab, CD"), (10, "quick brown fox jumps"), (3, None), (4, " .. "), (2, "ab cd")]
    rows = [(1, "see THE Quick brown... fox jumps; over the quick brown fox"), (2, "ab cd ab"), (3, None), (4, ""), (None, "été ab_cd"), (5, "quick brown fox runs"), (2, "ab cd ab"), (6, "word " * 2000 + "ab cd")]
    df = spark.createDataFrame([(i, t, "e", "z") for i, t in rows], "doc_id long, text string, lang string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.scan(df, bench, n=4).collect())
    want = slow_decontaminate(rows, items, 4)
    assert got == want
    more = df.withColumns({c: F.lit(7) for c in ("items", "spans", "contaminated", "key", "odd name.x")})
    clean = decontaminate.drop_contaminated(more, bench, n=4)
    assert clean.columns == more.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [3, 4, 5]
    cut = {r.doc_id: (r.text, r.n_removed) for r in decontaminate.remove_spans(more, bench, n=4).collect()}
    assert cut[1] == ("see over ", 9) and cut[2] == ("ab", 2) and cut[3] == (None, 0)
    assert decontaminate.scan(df, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.scan(df.limit(0), bench).count() == 0


def test_removal_with_a_benchmark_of_several_slices(spark, monkeypatch):
    items = [(1, "The quick-brown fox jumps"), (2, "ab, CD"), (10, "over the lazy dog"), (3, None)]
    rows = [(1, "see THE Quick brown fox jumps; over the lazy dog, ab cd"), (2, "ab cd ab"), (2, "ab cd ab"), (2, "of the same id"), (None, "no id"), (None, "no id ab cd"), (None, None), (5, "the lazy dog"), (6, "")]
    df = spark.createDataFrame([(i, t, f"key{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = [sorted(map(repr, f(df, bench, n=4).collect())) for f in (decontaminate.drop_contaminated, decontaminate.remove_spans)]
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 4)
    for n, f in enumerate((decontaminate.drop_contaminated, decontaminate.remove_spans)):
        assert sorted(map(repr, f(df, bench, n=4).collect())) == whole[n]
    assert [r.key for r in decontaminate.drop_contaminated(df, bench, n=4).orderBy("key").collect()] == ["key3", "key4", "key6", "key7", "key8"]
    assert sorted(r.n_removed for r in decontaminate.remove_spans(df, bench, n=4).collect()) == [0, 0, 0, 0, 0, 2, 2, 2, 11]


# --- 7


def slow_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over bytes, by dictionaries."""
    top = Counter()
    for t in texts:
        s = [0] * (order - 1) + list(t.encode())
        top.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n = {i: sum(v == i for v in c.values()) for i in (1, 2, 3, 4)}
        y = n[1] / max(n[1] + 2 * n[2], 1)
        discount[k] = {i: max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 for i in (1, 2, 3)}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        follow = {h: v for h, v in counts[k].items() if h[:-1] == g[:-1]}
        if not follow:
            return p(g[1:])
        total = sum(follow.values())
        gamma = sum(discount[k][min(v, 3)] for v in follow.values()) / total
        v = counts[k].get(g, 0)
        return (max(v - discount[k][min(v, 3)], 0) / total if v else 0) + gamma * p(g[1:])

    return p


def slow_bits(p, text, order):
    s = [0] * (order - 1) + list((text or "").encode())
    return sum(-math.log2(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1))


def slow_fold(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r[0] for r in df.select(F.pmod(F.xxhash64("text"), F.lit(quality.HOLD_OUT))).collect()]


def test_perplexity_and_limits(spark, monkeypatch):
    """Perplexity, limit and decision of every document against dictionaries, over several chunks, blocks and languages."""
    monkeypatch.setattr(quality, "CHUNK_BYTES", 300)
    monkeypatch.setattr(quality, "HELD", 100)
    rng = np.random.default_rng(1)
    words = ["abab", "banana", "band", "Über", "naïve", "stand", "and"]
    rows = [(i, " ".join(rng.choice(words, 9)), ("en", "fr", None)[i % 3]) for i in range(40)]
    rows += [(100, "zzz###", "en"), (101, "", "fr"), (102, None, "en"), (103, "abab\x00xyz!", "xx"), (None, "band and", "en"), (1, "another of this id", "fr"), (104, "banana " * 200, "fr")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, model string, n int").repartition(3).cache()
    trusted = set(range(0, 30))
    labels = spark.createDataFrame([(i, 1, 0) for i in sorted(trusted)] + [(100, 0, 0), (101, 1, 1)], "doc_id long, quality int, toxic int")
    fold = slow_fold(spark, [t for _, t, _ in rows])
    train = [(t, x) for (i, t, x), f in zip(rows, fold, strict=True) if i in trusted and f and t]
    known = {x: n for n, x in enumerate(sorted({x for i, _, x in rows if i in trusted and x}), 1)}
    models = {x: slow_kneser_ney([t for t, y in train if y == x], quality.ORDER) for x in known} | {None: slow_kneser_ney([t for t, _ in train], quality.ORDER)}
    of = lambda x: x if x in known else None
    bits = [slow_bits(models[of(x)], t, quality.ORDER) for _, t, x in rows]
    size = [len((t or "").encode()) for _, t, _ in rows]
    held = {m: [(bits[k], size[k]) for k, (i, t, x) in enumerate(rows) if i in trusted and not fold[k] and t and of(x) == m] for m in models}
    assert sum(map(len, held.values())) and len(known) == 2
    means = {m: sum(b for b, _ in v) / sum(n for _, n in v) for m, v in held.items() if v}
    drawn = lambda b, n, m: (b + quality.PRIOR * means[m]) / (n + quality.PRIOR)
    limit = {m: sorted(drawn(b, n, m) for b, n in v)[math.ceil(quality.QUANTILE * len(v)) - 1] * (quality.SLACK + quality.FEW / len(v)) for m, v in held.items() if v}
    loosest = max(limit, key=limit.get)
    want = []
    for (i, t, x), b, n in zip(rows, bits, size, strict=True):
        m = of(x)
        most = limit.get(m, limit[loosest])
        draw = (b + quality.PRIOR * means.get(m, means[loosest])) / (n + quality.PRIOR)
        want.append((-1 if i is None else i, t or "", 2 ** (b / n) if n else None, 2**most, n > 0 and draw <= most))
        assert abs(draw - most) > 0.01  # none is near the limit
    model = quality.train(docs, labels)
    assert model.names == known
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and {r.lang for r in got} == {"en", "fr", "xx", None}
    want.sort(key=lambda r: (r[0], len(r[1].encode())))
    for r, w in zip(sorted(got, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_symbols)), want, strict=True):
        assert r.perplexity == pytest.approx(w[2], rel=0.01) if w[2] else r.perplexity is None
        assert r.threshold == pytest.approx(w[3], rel=0.01) and r.keep == w[4]
    assert {w[4] for w in want if w[1]} == {True, False}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect()) == sorted((w[0], w[1]) for w in want if w[4])


def test_quality_keeps_clean_text_and_rejects_noise(spark):
    rng = np.random.default_rng(3)
    words = ["the", "cat", "sat", "on", "mat", "and", "then", "ran", "home", "with", "friends"]
    clean = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    noise = ["".join(rng.choice(list("#$%&*@!0123456789QXZ"), 200)) for _ in range(10)]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(clean + noise)] + [(100, None, "en"), (101, "", "xx"), (None, clean[0], "xx"), (0, clean[0], None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(60, 0, 0), (61, 1, 1), (None, 1, 0), (62, 1, None), (63, 1, 0), (63, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    kept = [(r.doc_id, r.keep) for r in got]
    assert len(kept) == len(rows) and all(k for i, k in kept if i is None or i < 60) and not any(k for i, k in kept if i is not None and i >= 60)
    good = quality.keep_good(docs, model)
    assert good.columns == docs.columns and good.count() == 62
    none = quality.train(docs, labels.limit(0))
    assert none is None and quality.keep_good(docs, none).count() == len(rows) - 2
    assert quality.score(docs.limit(0), none).count() == 0 and quality.score(docs.limit(0), model).count() == 0 and quality.keep_good(docs.limit(0), model).count() == 0


def test_documents_that_change_between_two_reads_fail_the_job():
    answers = quality.Answers([[np.array([5, 9], np.uint64), np.zeros(2, np.int16), np.zeros(2, np.int16)]])
    with pytest.raises(RuntimeError):
        answers.bits(np.array([7], np.uint64))


# --- 9


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = [(i, f"http://h/{i}", f"<p>page {i % 7} " + "text é " * (i % 5) + "</p>") for i in range(1, 60)] + [(100, None, None), (101, "u\nv", ""), (102, "u", ""), (None, "n", pages_html := "<p>page 1 text é </p>"), (103, "u", "x" * 20000), (5, "again", "<p>page 5 </p>")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/warc"
    written = warc.write(df, folder)
    assert sum(r.n_records for r in written.collect()) == len(pages) and written.count() > 1
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 10**9), i)
    want = Counter()
    for i, u, h in pages:
        raw = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and i != to
        want[(i, u.replace("\n", " ") if u else None, len(raw), warc.digest_of(raw), "revisit" if revisit else "response", to if revisit else None, None if revisit else raw)] += 1
    got = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in warc.read(spark, folder).collect())
    assert got == want and pages_html
    assert warc.write(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_checks():
    good = warc.record(1, "u", b"body", warc.digest_of(b"body"), None)
    assert warc.parse(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodY"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: ", b"Content-Length: 1"), good.replace(b"WARC-Record-ID", b"X"), b""):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)
    import zstandard

    frame = zstandard.ZstdCompressor().compress(good)
    whole = warc.leading_frame(b"") + frame + frame
    assert list(warc.records(whole)) == [good, good]
    for bad in (whole[:-3], frame, whole + b"junk", b"\x5d"):
        with pytest.raises(warc.BadArchive):
            list(warc.records(bad))


def test_tables_can_be_dropped(spark):
    t = common.table(spark.range(3), "x")
    assert t.count() == 3
    common.drop_tables(spark)
    assert not common._written
    assert isinstance(pa.__version__, str) and xxhash.xxh64_intdigest(b"", 42)
