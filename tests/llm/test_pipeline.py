"""Each stage of the pipeline against brute force on its own input."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestrata.llm import simhash  # noqa: E402


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [a + b for a in ("ban", "tel", "mor", "vis") for b in ("ana", "ine", "o", "uth", "er")]
    text = lambda n: " ".join(rng.choice(words, n))
    bench = [(i, text(14)) for i in range(3)]
    docs = [(i, text(60), "en", f"s{i % 3}") for i in range(80)]
    docs += [(100 + i, docs[i][1], "en", "copy") for i in range(10)]
    docs += [(200, "#$%! 77 @@ &&" * 30, "en", "s0"), (201, text(20) + " " + bench[1][1] + " " + text(20), "en", "s1"), (202, text(40) + ' token = "0123456789abcdef0123"', "en", "s2")]
    frame = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200, 0, 0), (202, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "benchmark", "secrets", "mix"]
    out, at = {}, frame
    for name, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).collect(), schema=stage(spark, at, str(tmp_path)).schema)
        out[name] = {r.doc_id: r for r in at.collect()}
        if name != "mix":
            assert at.columns == frame.columns
    assert set(out["quality"]) == {d[0] for d in docs} - {200}
    fp = {i: simhash.fingerprint(r.text) for i, r in out["quality"].items()}
    near = {i for i in fp if not any(j < i and bin(fp[i] ^ fp[j]).count("1") <= 2 for j in fp)}
    assert set(out["near copies"]) == near and not near & set(range(100, 110))
    assert set(out["benchmark"]) == near - {201}
    assert out["secrets"][202].text.endswith(" [SECRET]\"") and out["secrets"][202].n_chars == len(out["secrets"][202].text)
    assert all(out["secrets"][i].text == out["benchmark"][i].text for i in out["secrets"] if i != 202)
    assert set(out["mix"]) <= set(out["secrets"]) and all(1 <= r.mix_times <= 3 for r in out["mix"].values())
    got = {r.doc_id: r.mix_times for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: r.mix_times for i, r in out["mix"].items()}


def test_nulls_empty_tables_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [a + b for a in ("ban", "tel", "mor", "vis") for b in ("ana", "ine", "o", "uth", "er")]
    text = lambda n: " ".join(rng.choice(words, n))
    names = ["key", "key2", "items", "spans", "n_hit", "model", "n", "bits", "single", "times", "size", "target", "lang"]
    rows = [(i, text(50), f"s{i % 3}") for i in range(60)]
    copy = rows[3][1]
    rows += [(None, text(40), None), (None, copy, "s1"), (None, None, None), (61, None, "s0"), (62, "", "s0"), (5, text(45), "s2"), (63, copy, None), (63, copy, None), (64, text(3000), "s1")]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([(i, t, s, None if t is None else len(t), *[None if n == "lang" and k % 2 else "en" for n in names]) for k, (i, t, s) in enumerate(rows)], schema)
    folders = []
    for name, docs, labelled, items in (("all", frame, 40, 2), ("bare", frame, 0, 0), ("none", frame.limit(0), 3, 1)):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(labelled)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(i, rows[20 + i][1][:200]) for i in range(items)] + [(9, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        folders.append(at)
    for at in folders:
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, at)
            assert out.columns == frame.columns, name
            docs = spark.createDataFrame(out.collect(), frame.schema)
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if at.endswith("none"):
            assert not got
        else:
            gone = {20, 21} if at.endswith("all") else set()
            want = [(i, t) for i, t, _ in rows if t and t != copy and i not in gone] + [(3, copy)]
            assert sorted(got, key=repr) == sorted(want, key=repr)
        mixed = corpus_pipeline.run(spark, at)
        assert mixed.columns == [*frame.columns, "mix_times"] and (mixed.count() > 0) != at.endswith("none")
