"""The engine on small corpora, each case by hand."""

import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import code, concepts, graph, incremental, model, prefetch, search, semantic, structure
from lodestrata.parse import scan
from lodestrata.plans import regex
from lodestrata.sources import directory, store


def corpus(spark, texts):
    rows = list(texts.items()) if isinstance(texts, dict) else [(f"f{i}.txt", t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")


def hits(spark, texts, pattern):
    return sorted((r.doc_id, r.line_number, r.match_start, r.match_end) for r in search.search(corpus(spark, texts), pattern).collect())


@pytest.mark.parametrize(
    ("texts", "pattern", "n"),
    [
        ([], "x", 0),
        (["fox fox fox"], "fox", 1),
        (["same\n" * 5], "same", 5),
        (["a$b\nf(x)\ny[1]"], r"\$", 1),
        (["a$b\nf(x)\ny[1]"], r"f\(x\)", 1),
        (["abc123\nxyz 456\n789"], "[0-9]{3}", 3),
        (["cab\nxyz"], "[a-c]+", 1),
        (["one\ntwo\nthree"], "one|two", 2),
        (["one\ntwo\nthree"], "one|two|three", 3),
        (["end word\nword end"], "^word", 1),
        (["end word\nword end"], "word$", 1),
        (["Case\ncase\nCASE"], "case", 1),
        (["Case\ncase\nCASE"], "(?i)case", 3),
        (["hello\nworld\n"], "", 3),
        (["naïve\n日本語\nplain"], "日本", 1),
        (["naïve\nÉ"], "(?i)é", 1),
        (["é1 x"], r"^\w\d", 1),
        (["x\r\ny\r"], "x$", 0),
        (["a\rb"], "a.b", 1),
        (["foo\nbar"], "foo\nbar", 0),
        (["x" * 200_000 + "needle"], "needle", 1),
    ],
)
def test_search(spark, texts, pattern, n):
    assert len(hits(spark, texts, pattern)) == n


def test_offsets_are_bytes(spark):
    assert hits(spark, ["日本 fn go\nfn"], "fn") == [(0, 1, 7, 9), (0, 2, 0, 2)]
    assert hits(spark, ["abc"], "x*") == [(0, 1, 0, 0)]


@pytest.mark.parametrize("pattern", ["[x", "(x", "(?=a)", "(?<!a)b", r"(a)\1", "a++", "(?>a)", "[a--b]", "[[:nope:]]", "*"])
def test_rejected(spark, pattern):
    with pytest.raises(regex.PatternError):
        search.search(corpus(spark, ["a"]), pattern)


def test_plans():
    assert regex.of_literal(b"ab") == regex.ANY
    assert regex.of_literal(b"aaaa") == regex.Gram(0x616161)
    assert len(regex.of_pattern("hello").parts) == 3
    assert isinstance(regex.of_pattern("hello|world"), regex.Either)
    assert regex.of_pattern("f.*o") == regex.ANY
    assert regex.of_pattern("abc|x") == regex.ANY
    assert regex.both(regex.ANY, regex.Gram(1), regex.both(regex.Gram(1), regex.Gram(2))) == regex.All((regex.Gram(1), regex.Gram(2)))
    assert T.unpack(T.pack(b"abc")) == b"abc"


WORDS = st.lists(st.sampled_from(["alpha", "beta", "al", "gamma ray", "été", "a|b", ""]), min_size=1, max_size=4)


@settings(max_examples=12, deadline=None)
@given(texts=st.lists(WORDS.map("\n".join), min_size=1, max_size=6), pattern=st.sampled_from(["alpha", "beta|gamma", "(al|be)ta?", "al.*a", "ét", "gamma (ray|x)", "x?alpha", "(beta)+", "[ab]eta"]))
def test_an_index_loses_no_match(spark, texts, pattern):
    files = corpus(spark, texts)
    key = lambda df: sorted((r.doc_id, r.line_number) for r in df.collect())
    assert key(search.indexed_search(files, search.postings(files), pattern)) == key(search.search(files, pattern))


def test_postings(spark):
    got = {(r.gram, r.doc_id) for r in search.postings(corpus(spark, ["hello", "ab", "aaaa", ""])).collect()}
    assert got == {(T.pack(g), 0) for g in (b"hel", b"ell", b"llo")} | {(T.pack(b"aaa"), 2)}


def test_languages(spark):
    paths = {"a/b.rs": "rust", "x.pyi": "python", "x.tsx": "typescript", "x.csv": None, "Makefile": None, ".rs": None, "a.PY": None, "d.e/f": None, "m.tf": "hcl"}
    df = spark.createDataFrame(list(paths.items()), "path string, want string").withColumn("got", T.language(F.col("path")))
    assert {r.path: r.got for r in df.collect()} == paths


SOURCE = {
    "a.py": "class K:\n    def m(self):\n        helper()\n        helper()\n\n    def n(self):\n        self.m()\n\n\ndef helper():\n    return 1\n",
    "b.py": "def chain():\n    n()\n\n\ndef helper():\n    helper()\n",
    "c.csv": "helper,1\n",
}


@pytest.fixture(scope="module")
def parsed(spark):
    files = corpus(spark, SOURCE)
    p = code.parse(files).cache()
    symbols = code.symbols(p)
    return files, symbols, graph.edges(graph.enclosed_calls(code.calls(p), symbols), symbols).cache()


def test_structure(spark, parsed):
    files, symbols, _ = parsed
    got = sorted((r.path, r.symbol_name, r.match_line_number) for r in structure.structural_search(files, symbols, "helper").collect())
    assert got == [("a.py", "helper", 10), ("a.py", "m", 3), ("b.py", "helper", 5), ("c.csv", "<module>", 1)]
    # a match on an indented header is looked up at the start of its line, which is the class's
    assert [r.symbol_name for r in structure.structural_search(files, symbols, "def m").collect()] == ["K"]
    body = structure.structural_search(files, symbols, "return 1", with_body=True).first().body
    assert body == "def helper():\n    return 1"


def test_graph(spark, parsed):
    _, _, edges = parsed
    pairs = lambda df: sorted((r.file, r.name) for r in df.collect())
    assert pairs(graph.callers(edges, "helper")) == [("a.py", "m")] * 4 + [("b.py", "helper")] * 2
    assert pairs(graph.callees(edges, "chain")) == [("a.py", "n")]
    got = sorted((r.depth, r.name, r.severity) for r in graph.impact(edges, "helper", 5).collect())
    assert got == [(1, "m", "WILL BREAK"), (2, "n", "MAY BREAK"), (3, "chain", "REVIEW")]
    assert [r.name for r in graph.impact(edges, "helper", 1).collect()] == ["m"]
    assert graph.impact(edges, "chain", 3).count() == 0


def test_layers_and_budget(spark, parsed):
    files, symbols, edges = parsed
    rows = [semantic.semantic_search(files, symbols, "return 1", n, edges).first() for n in (0, 1, 7)]
    assert rows[0].signature is None and rows[0].body is None and rows[0].tokens == 6  # a.py:10:function helper
    assert rows[1].signature == "def helper():" and rows[1].called_by == ["helper", "m"] and rows[1].body is None
    assert rows[2].body.startswith("def helper") and rows[2].calls is None
    r = spark.createDataFrame([(i, 0, n) for i, n in enumerate((50, 80, 200))], "doc_id long, ord int, tokens int")
    assert [semantic.fit_budget(r, b, ["doc_id"]).count() for b in (150, 50, 10, 330)] == [2, 1, 1, 3]
    assert '"signature"' not in semantic.to_json(semantic.semantic_search(files, symbols, "return 1", 0, edges)).first().json
    low = semantic.semantic_search(files, symbols, "helper\\(\\)", 0, edges)
    full = semantic.semantic_search(files, symbols, "helper\\(\\)", 2, edges)
    up = {(r.doc_id, r.ord): r for r in semantic.upgrade_first(low, full, 10_000, ["doc_id", "ord"]).collect()}
    assert [r.body is not None for _, r in sorted(up.items())] == [True] + [False] * (len(up) - 1)


LANGUAGES = {
    "csharp": (
        "using System;\n\nnamespace Shop {\n  public interface IPrice {\n    decimal Of(string id);\n  }\n  public class Cart : IPrice {\n    private int n;\n    public Cart(int n) { this.n = n; }\n    public decimal Of(string id) {\n      await Load(id);\n      return Lookup(id);\n    }\n    int Twice(int x) => x * 2;\n  }\n  struct P { public int X; }\n  enum Kind { A, B }\n}\n",
        ["interface IPrice 4-6", "method Of 5-5", "class Cart 7-15", "method Of 10-13", "method Twice 14-14", "struct P 16-16", "enum Kind 17-17"],
        {"Load", "Lookup"},
    ),
    "java": (
        "interface Shape {\n  double area() throws Bad;\n}\n\nclass Box implements Shape {\n  Box(int n) {\n    init(n);\n  }\n  public double area() {\n    return mul(2, 3);\n  }\n}\n",
        ["interface Shape 1-3", "method area 2-2", "class Box 5-12", "method area 9-11"],
        {"init", "mul"},
    ),
    "php": ("<?php\nuse App\\Model;\n\nclass Cart {\n  public function total($x) {\n    return add($x);\n  }\n}\n\ninterface Priced {\n}\n\nfunction add($a) {\n  return $a + 1;\n}\n", ["class Cart 4-8", "method total 5-7", "interface Priced 10-11", "function add 13-15"], {"add"}),
    "swift": ("import Foundation\n\nstruct Point {\n  func norm() -> Double {\n    return root(x)\n  }\n}\n\nprotocol Shape {\n}\n\nfunc root(_ x: Double) -> Double {\n  return x\n}\n", ["struct Point 3-7", "function norm 4-6", "interface Shape 9-10", "function root 12-14"], {"root"}),
    "scala": ("object Main {\n  def run(x: Int): Int = {\n    twice(x)\n  }\n}\n\nclass Box {\n  def twice(x: Int) = x + x\n}\n\ntrait Show\n", ["class Main 1-5", "function run 2-4", "class Box 7-9", "function twice 8-8", "trait Show 11-11"], {"twice"}),
    "lua": ('local m = require("mod")\n\nfunction add(a, b)\n  return twice(a) + b\nend\n\nlocal function twice(x)\n  return x * 2\nend\n\nlocal f = function(y) return y end\n', ["function add 3-5", "function twice 7-9"], {"require", "twice"}),
    "zig": ("pub fn add(a: i32, b: i32) i32 {\n    return twice(a) + b;\n}\n\nfn twice(x: i32) i32 {\n    return x * 2;\n}\n", ["function add 1-3", "function twice 5-7"], {"twice"}),
    "bash": ('greet() {\n  say "$1"\n}\n\nfunction say {\n  echo "$1"\n}\n', ["function greet 1-3", "function say 5-7"], {"say", "echo"}),
    "hcl": ('variable "name" {\n  default = "x"\n}\n\nresource "aws_s3_bucket" "b" {\n  bucket = "y"\n}\n', ["function variable 1-3", "function resource 5-7"], set()),
    "cpp": ("#include <vector>\n\nnamespace geo {\nclass Box {\n public:\n  int area() const {\n    return mul(w, h);\n  }\n};\n\nstruct P { int x; };\n\nenum class Kind { A };\n\nint mul(int a, int b) {\n  return a * b;\n}\n}\n", ["class Box 4-9", "function area 6-8", "struct P 11-11", "enum Kind 13-13", "function mul 15-17"], {"mul"}),
}


@pytest.mark.parametrize("lang", LANGUAGES)
def test_languages_that_the_fixture_tree_has_not(lang):
    src, symbols, calls = LANGUAGES[lang]
    assert [f"{s.kind} {s.name} {s.line_start}-{s.line_end}" for s in scan.symbols(src.encode(), lang)] == symbols
    assert {c.name for c in scan.calls(src.encode(), lang)} == calls


def test_symbols_of_501_lines_are_left_out():
    src = ("class Big:\n    def small(self):\n        pass\n" + "    x = 1\n" * 520).encode()
    assert [s.name for s in scan.symbols(src, "python")] == ["small"]
    assert [s.name for s in scan.symbols(b"def f(:\n    g(1)\n\ndef h():\n    pass\n", "python")] == ["f", "h"]


def test_concepts_and_bloom(spark):
    files = corpus(spark, {"a.py": "import redis\nfrom fast_api import x as y\n", "b.txt": "we use Postgres and REST", "Cargo.toml": "[dependencies]\nmy-lib = 1\n"})
    table = concepts.concepts(files).cache()
    names = {r.concept for r in table.collect()}
    assert {"redis", "fast_api", "postgresql", "rest-api", "txt", "b.txt", "my_lib", "my-lib", "toml"} <= names and "kafka" not in names
    asked = spark.createDataFrame([("REDIS",), ("kafka",)], "name string")
    assert {r.name: r.present for r in concepts.exists(table, asked).collect()} == {"REDIS": True, "kafka": False}
    b = concepts.Bloom()
    assert (b.bits, b.hashes, b.size_bytes, b.is_empty) == (95851, 7, 11984, True)
    there = spark.range(10_000).select(F.concat(F.lit("Item"), F.col("id").cast("string")).alias("x"))
    b.add(there, "x")
    assert b.insertions == 10_000
    assert b.might_contain(there.select(F.upper("x").alias("x")), "x").where("not present").isEmpty()
    other = spark.range(10_000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("x"))
    assert b.might_contain(other, "x").where("present").count() < 300


def test_model(spark, parsed):
    files, symbols, edges = parsed
    m = model.build(files, symbols, graph.name_degrees(edges))
    assert m["structure"] == [{"path": ".", "file_count": 3, "description": "1 class, 5 functions"}]
    assert m["languages"] == [{"language": "python", "files": 2}, {"language": "csv", "files": 1}]
    assert m["key_symbols"][0]["name"] == "helper" and m["dependencies"] == ["Python"]
    assert m["text"].startswith("# Codebase Mental Model\n\n## Languages\n- python: 2 files\n") and m["tokens"] == -(-len(m["text"]) // 4)
    empty = corpus(spark, [])
    assert model.build(empty, symbols.limit(0), graph.name_degrees(edges.limit(0)))["text"] == "# Codebase Mental Model\n\n## Languages\n\n## Structure\n\n"
    many = corpus(spark, {f"d{i:02}/x.txt": "" for i in range(20)})
    assert sorted(r.path for r in model.directories(many, symbols.limit(0)).collect()) == [f"d{i:02}" for i in range(15)]


def test_prediction(spark, parsed):
    files, symbols, edges = parsed
    ask = lambda p: [(r.query_type, r.arg, r.confidence) for r in prefetch.predict(spark.createDataFrame([(p,)], "pattern string"), prefetch.first_file(files, p), symbols, edges).orderBy("rank").collect()]
    assert ask("zz_top") == [("callers", "zz_top", 0.7), ("impact", "zz_top", 0.4)]
    assert ask("test_helper")[0] == ("search", "helper", 0.75)
    assert ("search", "handle", 0.6) in ask("an error") and ask("a b") == []
    assert ("search", "helper", 0.35) in ask("class K")
    cache = prefetch.Cache()
    cache.fill(prefetch.predict(spark.createDataFrame([("m",), ("helper",)], "pattern string")), {"callers": lambda n: graph.callers(edges, n)})
    assert cache.get("callers", "helper").count() == 6 and cache.get("callers", "x") is None
    assert cache.hit_rate == 50.0
    cache.clear()


def test_store_and_refresh(spark, tmp_path):
    tree, root = tmp_path / "tree", f"file://{tmp_path}/index"
    (tree / "__pkg").mkdir(parents=True)
    for name, text in {"a.txt": "old words", "__pkg/__init__.py": "kept = 1", "b.txt": "stays"}.items():
        (tree / name).write_text(text)
    assert store.load(spark, root) is None
    listing = lambda: directory.files(spark, str(tree), texts=False).drop("text")
    read = lambda wanted: directory.files(spark, str(tree)).join(wanted.select("path"), "path", "left_semi").select("doc_id", "path", "size", "mtime", "text")
    t = incremental.refresh(spark, root, listing(), read)
    assert t["files"].count() == 3
    (tree / "a.txt").write_text("new things here")
    (tree / "c.txt").write_text("another")
    (tree / "b.txt").unlink()
    t = incremental.refresh(spark, root, listing(), read)
    find = lambda p: sorted(r.path for r in search.indexed_search(t["files"], t["postings"], p).collect())
    assert find("new things") == ["a.txt"] and find("old") == [] and find("another") == ["c.txt"] and find("stays") == [] and find("kept") == ["__pkg/__init__.py"]
    assert t["files"].select("doc_id").distinct().count() == 3
    for f in (tmp_path / "index" / "_meta").iterdir():
        f.unlink()
    assert store.load(spark, root) is None


def test_directory(spark, tmp_path):
    for name, text in {"a.py": "word", "_priv/x.py": "word", ".hidden/h.py": "word", "build/o.py": "word", "keep.log": "word", "x.log": "word", "sub/build": "word", "bin.dat": "wo\0rd", "sub/deep/t.tmp": "word"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("# ignored\nbuild/\n*.log\n!keep.log\nsub/**/*.tmp\n")
    (tmp_path / "bad.txt").write_bytes(b"a\xffb word")
    df = directory.files(spark, str(tmp_path))
    assert sorted(r.path for r in df.collect()) == ["_priv/x.py", "a.py", "bad.txt", "keep.log", "sub/build"]
    assert search.search(df, "word").count() == 5
    assert "\ufffd" in df.where("path = 'bad.txt'").first().text


def test_cli(spark, tmp_path, capsys):
    from lodestrata import cli

    for name, text in SOURCE.items():
        (tmp_path / name).write_text(text)
    run = lambda *a: (cli.main([*a, str(tmp_path)] if not a[0].startswith("--") else ["", str(tmp_path), *a]), capsys.readouterr().out)
    assert run("return 1") == (0, "a.py:11:    return 1\n")
    assert run("-c", "helper") == (0, "6\n")
    assert run("-l", "helper")[1].split() == ["a.py", "b.py", "c.csv"]
    assert run("nothing here")[0] == 1
    assert "[WILL BREAK] depth 1: a.py: m" in run("--impact", "helper")[1]
    assert run("--exists", "kafka")[1] == "kafka: NO (definite)\n"
    assert cli.main(["--layer", "1", "--json", "return 1", str(tmp_path)]) == 0
    assert '"signature":"def helper():"' in capsys.readouterr().out


def test_cli_with_an_index(spark, tmp_path, capsys):
    from lodestrata import cli

    tree, index = tmp_path / "tree", f"file://{tmp_path}/index"
    tree.mkdir()
    for i in range(6):
        (tree / f"f{i}.py").write_text(f"def name{i}():\n    return {i}\n")
    (tree / "bin.py").write_bytes(b"\0name1")
    run = lambda *a: (cli.main([*a, str(tree), "--index", index]), capsys.readouterr().out)
    assert run("name1") == (0, "f1.py:1:def name1():\n")
    assert run("-c", "name.")[1] == "6\n"  # more than half of the files: a scan
    (tree / "f1.py").unlink()
    (tree / "f9.py").write_text("name1 = 9\n")
    (tree / "f2.py").write_text("name1 = name2 = 3\n")
    assert run("name1")[1] == "f2.py:1:name1 = name2 = 3\nf9.py:1:name1 = 9\n"
    assert run("-s", "return 3") == (0, "f3.py:1-2 function name3\ndef name3():\n    return 3\n")
    assert run("--layer", "0", "return 4") == (0, "f4.py:1-2 function name4 (6 tokens)\n")
    assert len(list((tmp_path / "index").glob("snapshot-*"))) == 2


def test_server_commands(tmp_path, capsys):
    from lodestrata import server

    at = str(tmp_path / "s")
    assert server.main([str(tmp_path), "--socket", at, "--status"]) == 1 and server.main([str(tmp_path), "--socket", at, "--stop"]) == 1
    (tmp_path / "s.pid").write_text(str(os.getpid()))
    assert server.main([str(tmp_path), "--socket", at, "--status"]) == 0 and server.main([str(tmp_path), "--socket", at]) == 1
    assert capsys.readouterr().out.splitlines()[-1] == f"running: {os.getpid()}"


def test_degrees_from_counts(spark, parsed):
    files, symbols, edges = parsed
    calls = graph.enclosed_calls(code.calls(code.parse(files)), symbols)
    assert sorted(map(tuple, graph.degrees(calls, symbols).collect())) == sorted(map(tuple, graph.name_degrees(edges).collect()))


def test_bloom_bits_are_those_of_the_items_one_by_one(spark):
    b = concepts.Bloom(40)
    items = spark.createDataFrame([(f"Item{i}",) for i in range(40)], "x string").repartition(5)
    b.add(items.limit(10), "x").add(items, "x")
    want = set()
    for r in items.select(F.xxhash64(F.lower("x")).alias("a"), F.xxhash64(F.lower("x"), F.lit(1)).alias("b")).collect():
        want |= {(r.a % b.bits + i * (r.b % b.bits)) % b.bits for i in range(b.hashes)}
    assert {i for i in range(b.bits) if b.words[i >> 3] >> (i & 7) & 1} == want and b.insertions == 50


def test_server(spark, tmp_path):
    from lodestrata.server import Server

    (tmp_path / "a.txt").write_text("find me")
    s = Server(spark, str(tmp_path), str(tmp_path / ".sock"))
    assert s.reply('{"ping": true}') == {"status": "ok"}
    assert s.reply('{"pattern": "find"}')["count"] == 1
    assert "error" in s.reply("nonsense") and "error" in s.reply('{"pattern": "(x"}')
    (tmp_path / "b.txt").write_text("find it")
    os.utime(tmp_path / "a.txt", (time.time(), time.time() + 5))
    assert s.refresh() == {"a.txt", "b.txt"}
    assert s.reply('{"pattern": "find"}')["count"] == 2
