"""The engine's driver queries, and SQL that says the same of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import code, concepts, graph, incremental, model, prefetch, search, semantic, structure
from .plans import regex
from .sources import corpus, fixtures, store
from .streaming import changes

PATTERN = "the.*tion"
LITERAL = "inthe"
CASED = "THERTI"
NAME = "erertion"
CALLER = "thwhatly"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents(spark, d)


def _talks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return corpus.conversations(spark, d), corpus.conversation_symbols(spark, d)


def _prose(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _docs(spark, d)
    symbols, calls = corpus.prose_symbols(files)
    return files, symbols, graph.edges(calls, symbols)


def _code(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = fixtures.files(spark)
    return files, store.keep(code.parse(files))


def text_search(spark, d):
    return search.search(_docs(spark, d), PATTERN)


def text_search_ci(spark, d):
    return search.search(_docs(spark, d), f"(?i){CASED}").select("path", "doc_id", "line_number", "line")


def match_offsets(spark, d):
    return search.search(_docs(spark, d), "ion [a-z]+").select("doc_id", "line_number", "match_start", "match_end")


def count_matches(spark, d):
    return search.count_matches(search.search(_docs(spark, d), PATTERN))


def files_with_matches(spark, d):
    return search.files_with_matches(search.search(_docs(spark, d), PATTERN))


def search_many(spark, d):
    found = search.search_many(_docs(spark, d), {"a": PATTERN, "b": LITERAL, "c": "ch$"})
    return found.select("pattern_id", "doc_id", "line_number")


def trigram_df(spark, d):
    return search.postings(_docs(spark, d)).groupBy("gram").agg(F.count("*").alias("docs"))


def candidates_and(spark, d):
    return search.candidates(search.postings(_docs(spark, d)), regex.both(regex.of_literal(b"thea"), regex.of_literal(b"tion")))


def candidates_or(spark, d):
    return search.candidates(search.postings(_docs(spark, d)), regex.either(regex.of_literal(b"bly"), regex.both(regex.of_literal(b"qui"), regex.of_literal(b"oie"))))


def indexed_search(spark, d):
    files = _docs(spark, d)
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    return search.indexed_search(files, store.keep(search.postings(files)), f"{LITERAL}|ndeas (the|of)", n).select("path", "doc_id", "line_number", "line")


def indexed_scan(spark, d):
    """A pattern that most files are candidates for: they are scanned, and the index isn't used."""
    files = store.keep(_docs(spark, d))
    return search.indexed_search(files, store.keep(search.postings(files)), PATTERN, files.count()).select("path", "doc_id", "line_number", "line")


def line_offsets(spark, d):
    return structure.line_offsets(_docs(spark, d))


def enclosing_symbol(spark, d):
    files, symbols = _talks(spark, d)
    found = structure.matches_in_symbols(files, symbols, PATTERN)
    return found.select("doc_id", "line_number", F.col("symbol.name").alias("symbol"), F.col("symbol.kind").alias("kind"))


def structural_search(spark, d):
    files, symbols = _talks(spark, d)
    return structure.structural_search(files, symbols, PATTERN).select("doc_id", "symbol_name", "symbol_kind", "line_start", "line_end", "match_line_number", "match_line")


def _prose_ranges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of prose with the bytes of their lines."""
    at = structure.line_offsets(files).withColumnRenamed("line_number", "ord")
    s = symbols.join(at, ["doc_id", "ord"]).withColumn("byte_start", F.col("byte_offset").cast("int"))
    return s.withColumn("byte_end", (F.col("byte_start") + F.octet_length("line")).cast("int"))


def structural_module_rows(spark, d):
    files = _docs(spark, d)
    symbols, _ = corpus.prose_symbols(files)
    found = structure.structural_search(files, _prose_ranges(files, symbols), LITERAL)
    return found.select("doc_id", "symbol_name", "match_line_number")


def _layer(spark, d, layer):
    files, symbols = _talks(spark, d)
    found = semantic.semantic_search(files, symbols, PATTERN, layer)
    return found.select("file", "name", "kind", F.col("line_range.start").alias("line_start"), F.col("line_range.end").alias("line_end"), *(["body"] if layer == 2 else []), "tokens")


def semantic_l0(spark, d):
    return _layer(spark, d, 0)


def semantic_l2(spark, d):
    return _layer(spark, d, 2)


def semantic_l1(spark, d):
    files, symbols, edges = _prose(spark, d)
    s = symbols.select("doc_id", "path", "ord", "kind", "name", "line_start", "line_end", F.col("line").alias("body"))
    out = semantic.compress(s, 1, edges)
    names = lambda c: F.array_join(c, ",").alias(c)
    return out.select("file", "name", F.col("line_range.start").alias("line_start"), "signature", names("calls"), names("called_by"), "tokens")


def budget_fit(spark, d):
    files, symbols = _talks(spark, d)
    return semantic.semantic_search(files, symbols, PATTERN, 2, budget=2000).select("file", "name", "tokens")


def result_json(spark, d):
    files, symbols = _talks(spark, d)
    return semantic.to_json(semantic.semantic_search(files, symbols, PATTERN, 0))


def upgraded_first(spark, d):
    files, symbols = _talks(spark, d)
    found = [semantic.semantic_search(files, symbols, PATTERN, layer) for layer in (0, 2)]
    out = semantic.upgrade_first(*found, 10**9, ["doc_id", "ord"])
    return out.select("file", "name", F.coalesce("body", F.lit("")).alias("body"), "tokens")


def call_edges(spark, d):
    return _prose(spark, d)[2]


def edge_count(spark, d):
    symbols, calls = corpus.prose_symbols(_docs(spark, d))
    return graph.edge_count(calls, symbols)


def callers(spark, d):
    return graph.callers(_prose(spark, d)[2], NAME)


def callees(spark, d):
    return graph.callees(_prose(spark, d)[2], CALLER)


def impact(spark, d):
    return graph.impact(_prose(spark, d)[2], NAME, 3)


def imports(spark, d):
    return corpus.links(spark, d)


def imported_by(spark, d):
    return graph.imported_by(corpus.links(spark, d), "/the")


def concept_keywords(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(concepts.keywords(F.col("text"))).alias("concept")).distinct()


ASKED = ("gin", "REST-API", "echo", "kubernetes", "txt", "0.txt")


def concept_exists(spark, d):
    asked = spark.createDataFrame([(x,) for x in ASKED], "name string")
    return concepts.exists(concepts.concepts(_docs(spark, d)), asked)


def bloom_exists(spark, d):
    """All concepts, and names that are none: at one false positive in a million these stay absent."""
    there = store.keep(concepts.concepts(_docs(spark, d)).select("concept").distinct())
    absent = spark.createDataFrame([(f"absent-{i}",) for i in range(20)], "concept string")
    return concepts.Bloom(there.count(), 1e-6).add(there, "concept").might_contain(there.unionByName(absent), "concept")


def manifest_deps(spark, d):
    from .operators.manifests import dependencies

    return dependencies(fixtures.files(spark)).select("path", "concept")


def import_concepts(spark, d):
    lines = search.lines(fixtures.files(spark))
    return lines.select("path", F.explode(concepts.imported_names(F.col("line"))).alias("name")).distinct()


def parsed_symbols(spark, d):
    return code.symbols(_code(spark)[1]).select("path", "kind", "name", "line_start", "line_end")


def parsed_calls(spark, d):
    return code.calls(_code(spark)[1]).select("path", "callee")


def parsed_imports(spark, d):
    return code.imports(_code(spark)[1])


def code_edges(spark, d):
    parsed = _code(spark)[1]
    s = code.symbols(parsed)
    return graph.edges(graph.enclosed_calls(code.calls(parsed), s), s)


def lang_counts(spark, d):
    return model.languages(fixtures.files(spark).select("path"))


def dir_summary(spark, d):
    files = _docs(spark, d)
    return model.directories(files, corpus.prose_symbols(files)[0])


def entry_points(spark, d):
    return model.entry_points(fixtures.files(spark))


def model_dependencies(spark, d):
    return model.dependencies(fixtures.files(spark))


def key_symbols(spark, d):
    symbols, calls = corpus.prose_symbols(_docs(spark, d))
    return model.key_symbols(symbols, graph.degrees(calls, symbols)).select("name", "file", "callers", "callees", "ord")


def hot_spots(spark, d):
    files, symbols, _ = _prose(spark, d)
    return model.hot_spots(files, symbols)


def index_stats(spark, d):
    files = _docs(spark, d)
    symbols, calls = corpus.prose_symbols(files)
    return model.stats(files, search.postings(files), symbols, graph.edge_count(calls, symbols), concepts.concepts(files)).select("files", "trigrams", "symbols", "edges", "concepts")


def _listing(spark, d) -> tuple[DataFrame, DataFrame]:
    """The documents as an earlier and a present listing: ids ending in 0 are gone, in 1 new, in 2 changed."""
    base = _docs(spark, d).withColumn("size", F.octet_length("text").cast("long")).withColumn("mtime", F.timestamp_seconds(F.lit(0)))
    last = F.pmod("doc_id", F.lit(10))
    return base.where(last != 1), base.where(last != 0).withColumn("size", F.when(last == 2, F.col("size") + 1).otherwise(F.col("size")))


def stale_files(spark, d):
    return store.compare(*_listing(spark, d))


def incremental_merge(spark, d):
    old, now = _listing(spark, d)
    last = F.pmod("doc_id", F.lit(10))
    changed = now.where(last.isin(1, 2)).withColumn("text", F.concat("text", F.lit(" changed")))
    after = incremental.merge(old, changed, old.where(last == 0))
    return after.select("doc_id", "path", F.octet_length("text").cast("long").alias("bytes"))


def index_refresh(spark, d):
    """An index of the earlier listing, saved, loaded and brought up to the present one: rows of files, and their trigrams."""
    old, now = _listing(spark, d)
    root = f"{store.folder(spark)}/index-{store.uuid.uuid4().hex[:12]}"
    columns = ["doc_id", "path", "size", "mtime", "text"]
    last = F.pmod("doc_id", F.lit(10))
    now = now.withColumn("text", F.when(last == 2, F.concat("text", F.lit("\x01"))).otherwise(F.col("text")))
    texts = lambda table: lambda listing: listing.join(table.select("path", "text"), "path").select(*columns)
    for table in (old, now):
        tables = incremental.refresh(spark, root, table.drop("text"), texts(table))
    grams = tables["postings"].groupBy("doc_id").agg(F.count("*").alias("grams"))
    return tables["files"].join(grams, "doc_id", "left").select("path", F.octet_length("text").cast("long").alias("bytes"), F.coalesce("grams", F.lit(0)).alias("grams"))


def debounce_sessions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("path"), "user_id", "ts")
    return changes.debounce(events, "6 hours", by="user_id").select("user_id", "start", F.array_join("paths", ",").alias("paths"), "n_events")


def predict_queries(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    patterns = events.select(F.col("event_type").alias("pattern")).distinct().unionByName(spark.createDataFrame([("test_click",), ("a.b",)], "pattern string"))
    return prefetch.best(prefetch.by_pattern(patterns))


QUERIES = {f.__name__: f for f in (
    text_search, text_search_ci, match_offsets, count_matches, files_with_matches, search_many, trigram_df, candidates_and, candidates_or, indexed_search, indexed_scan,
    line_offsets, enclosing_symbol, structural_search, structural_module_rows, semantic_l0, semantic_l1, semantic_l2, budget_fit, result_json, upgraded_first,
    call_edges, edge_count, callers, callees, impact, imports, imported_by, concept_keywords, concept_exists, bloom_exists, manifest_deps, import_concepts,
    parsed_symbols, parsed_calls, parsed_imports, code_edges, lang_counts, dir_summary, entry_points, model_dependencies, key_symbols, hot_spots, index_stats,
    stale_files, incremental_merge, index_refresh, debounce_sessions, predict_queries,
)}

_FILES = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path, coalesce(text, '') AS text FROM documents)"
_LINES = _FILES + ", cut AS (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM files), lines AS (SELECT doc_id, path, (i + 1)::INTEGER AS line_number, l[i + 1] AS line FROM cut, LATERAL (SELECT unnest(range(len(l))) AS i))"
_DEFS = _LINES + r""", named AS (SELECT *, regexp_extract(lower(line), '^\p{L}+') AS name FROM lines), defs AS (SELECT * FROM named WHERE length(name) >= 8),
calls AS (SELECT path, name AS caller, unnest(regexp_extract_all(lower(line), '\p{L}{8,}')) AS callee FROM defs),
edges AS (SELECT c.path AS from_file, caller AS from_name, d.path AS to_file, d.name AS to_name FROM calls c JOIN defs d ON callee = d.name WHERE callee <> caller)"""
_TURNS = """t AS (SELECT conv_id AS doc_id, 'conv/' || conv_id::VARCHAR || '.txt' AS path, turn, role, coalesce(text, '') AS text, len(string_split(coalesce(text, ''), chr(10))) AS n FROM conversations),
turns AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS before FROM t),
tl AS (SELECT doc_id, path, turn, role, text, (before + i)::INTEGER AS line_number, string_split(text, chr(10))[i] AS line, (before + 1)::INTEGER AS line_start, (before + n)::INTEGER AS line_end FROM turns, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
hits AS (SELECT * FROM tl WHERE regexp_matches(line, 'the.*tion')),
first AS (SELECT doc_id, path, turn, role, text, line_start, line_end, min(line_number) AS match_line_number, arg_min(line, line_number) AS match_line FROM hits GROUP BY ALL)"""


def _tokens(expr: str) -> str:
    return f"((strlen({expr}) + 3) // 4)::INTEGER"


_HEAD = "path || ':' || line_start || ':' || role || ' turn' || turn"

SQL = {
    "text_search": f"WITH {_LINES}, m AS (SELECT *, regexp_extract(line, 'the.*tion') AS x FROM lines WHERE regexp_matches(line, 'the.*tion')) SELECT path, doc_id, line_number, line, strlen(line[1:instr(line, x) - 1])::INTEGER AS match_start, (strlen(line[1:instr(line, x) - 1]) + strlen(x))::INTEGER AS match_end FROM m",
    "text_search_ci": f"WITH {_LINES} SELECT path, doc_id, line_number, line FROM lines WHERE regexp_matches(line, '(?i)therti')",
    "match_offsets": f"WITH {_LINES}, m AS (SELECT *, regexp_extract(line, 'ion [a-z]+') AS x FROM lines WHERE regexp_matches(line, 'ion [a-z]+')) SELECT doc_id, line_number, strlen(split_part(line, x, 1))::INTEGER AS match_start, (strlen(split_part(line, x, 1)) + strlen(x))::INTEGER AS match_end FROM m",
    "count_matches": f"WITH {_LINES} SELECT count(*) AS matches FROM lines WHERE regexp_matches(line, 'the.*tion')",
    "files_with_matches": f"WITH {_LINES} SELECT DISTINCT doc_id, path FROM lines WHERE regexp_matches(line, 'the.*tion')",
    "search_many": f"WITH {_LINES} SELECT p.id AS pattern_id, doc_id, line_number FROM lines JOIN (VALUES ('a', 'the.*tion'), ('b', '{LITERAL}'), ('c', 'ch$')) p(id, re) ON regexp_matches(line, re)",
    "trigram_df": "WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), c AS (SELECT doc_id, unnest([substr(h, 512 * k + 1, 516) FOR k IN range(length(h) // 512 + 1)]) AS s FROM d), g AS (SELECT DISTINCT doc_id, unnest([substr(s, 2 * i + 1, 6) FOR i IN range(greatest(length(s) // 2 - 2, 0))]) AS g FROM c) SELECT ('0x' || g)::INTEGER AS gram, count(*) AS docs FROM g GROUP BY g",
    "candidates_and": "SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'hea') AND contains(text, 'tio') AND contains(text, 'ion')",
    "candidates_or": "SELECT doc_id FROM documents WHERE contains(text, 'bly') OR contains(text, 'qui') AND contains(text, 'oie')",
    "indexed_search": f"WITH {_LINES} SELECT path, doc_id, line_number, line FROM lines WHERE regexp_matches(line, '{LITERAL}|ndeas (the|of)')",
    "indexed_scan": f"WITH {_LINES} SELECT path, doc_id, line_number, line FROM lines WHERE regexp_matches(line, 'the.*tion')",
    "line_offsets": f"WITH {_LINES} SELECT doc_id, line_number, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM lines",
    "enclosing_symbol": f"WITH {_TURNS} SELECT doc_id, line_number, 'turn' || turn AS symbol, role AS kind FROM hits",
    "structural_search": f"WITH {_TURNS} SELECT doc_id, 'turn' || turn AS symbol_name, role AS symbol_kind, line_start, line_end, match_line_number, match_line FROM first",
    "structural_module_rows": f"WITH {_DEFS} SELECT doc_id, CASE WHEN length(name) >= 8 THEN name ELSE '<module>' END AS symbol_name, line_number AS match_line_number FROM named WHERE contains(line, '{LITERAL}')",
    "semantic_l0": f"WITH {_TURNS} SELECT path AS file, 'turn' || turn AS name, role AS kind, line_start, line_end, {_tokens(_HEAD)} AS tokens FROM first",
    "semantic_l1": f"""WITH {_DEFS}, o AS (SELECT from_name AS name, array_to_string(list_sort(list(DISTINCT to_name)), ',') AS calls FROM edges GROUP BY 1), i AS (SELECT to_name AS name, array_to_string(list_sort(list(DISTINCT from_name)), ',') AS called_by FROM edges GROUP BY 1),
r AS (SELECT path AS file, defs.name, line_number AS line_start, trim(split_part(line, '{{', 1)) AS signature, calls, called_by FROM defs LEFT JOIN o ON o.name = defs.name LEFT JOIN i ON i.name = defs.name)
SELECT *, {_tokens("file || ':' || line_start || ':function ' || name || ' sig:' || signature || ' calls:[' || coalesce('\"' || replace(calls, ',', '\", \"') || '\"', '') || '] called_by:[' || coalesce('\"' || replace(called_by, ',', '\", \"') || '\"', '') || ']'")} AS tokens FROM r""",
    "semantic_l2": f"WITH {_TURNS} SELECT path AS file, 'turn' || turn AS name, role AS kind, line_start, line_end, text AS body, {_tokens('text')} AS tokens FROM first",
    "budget_fit": f"WITH {_TURNS}, s AS (SELECT *, {_tokens('text')} AS tokens FROM first), r AS (SELECT *, sum(tokens) OVER w AS upto, row_number() OVER w AS k FROM s WINDOW w AS (ORDER BY doc_id, match_line_number ROWS UNBOUNDED PRECEDING)) SELECT path AS file, 'turn' || turn AS name, tokens FROM r WHERE upto <= 2000 OR k = 1",
    "result_json": f"""WITH {_TURNS} SELECT '{{"file":"' || path || '","name":"turn' || turn || '","kind":"' || role || '","line_range":{{"start":' || line_start || ',"end":' || line_end || '}},"tokens":' || {_tokens(_HEAD)} || '}}' AS json FROM first""",
    "upgraded_first": f"WITH {_TURNS}, k AS (SELECT *, row_number() OVER (ORDER BY doc_id, match_line_number) = 1 AS one FROM first) SELECT path AS file, 'turn' || turn AS name, CASE WHEN one THEN text ELSE '' END AS body, CASE WHEN one THEN {_tokens('text')} ELSE {_tokens(_HEAD)} END AS tokens FROM k",
    "call_edges": f"WITH {_DEFS} SELECT * FROM edges",
    "edge_count": f"WITH {_DEFS} SELECT count(*) AS edges FROM edges",
    "callers": f"WITH {_DEFS} SELECT from_file AS file, from_name AS name FROM edges WHERE to_name = '{NAME}'",
    "callees": f"WITH {_DEFS} SELECT to_file AS file, to_name AS name FROM edges WHERE from_name = '{CALLER}'",
    "impact": f"""WITH RECURSIVE {_DEFS}, e AS (SELECT DISTINCT * FROM edges),
w(file, name, depth) AS (SELECT DISTINCT to_file, to_name, 0 FROM e WHERE to_name = '{NAME}' UNION SELECT from_file, from_name, depth + 1 FROM w JOIN e ON to_file = file AND to_name = name WHERE depth < 3),
f AS (SELECT file, name, min(depth)::INTEGER AS depth FROM w GROUP BY ALL)
SELECT *, CASE depth WHEN 1 THEN 'WILL BREAK' WHEN 2 THEN 'MAY BREAK' ELSE 'REVIEW' END AS severity FROM f WHERE depth > 0""",
    "imports": """SELECT url AS path, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages""",
    "imported_by": """SELECT path FROM (SELECT url AS path, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) WHERE target = '/the'""",
    "concept_keywords": "SELECT DISTINCT doc_id, c AS concept FROM documents JOIN (VALUES " + ", ".join(f"('{k}', '{concepts.RENAMED.get(k, k)}')" for k in concepts.KEYWORDS) + ") k(p, c) ON contains(lower(text), p)",
    "concept_exists": f"WITH {_FILES} SELECT a.name, (CASE lower(a.name) WHEN 'txt' THEN (SELECT count(*) FROM files) WHEN '0.txt' THEN (SELECT count(*) FROM files WHERE doc_id = 0) ELSE (SELECT count(*) FROM files WHERE contains(lower(text), CASE lower(a.name) WHEN 'rest-api' THEN 'rest' ELSE lower(a.name) END)) END) > 0 AS present FROM (VALUES {', '.join(f'({x!r})' for x in ASKED)}) a(name)",
    "bloom_exists": f"WITH {_FILES} SELECT DISTINCT concept, true AS present FROM (SELECT c AS concept FROM files JOIN (VALUES " + ", ".join(f"('{k}', '{concepts.RENAMED.get(k, k)}')" for k in concepts.KEYWORDS) + ") k(p, c) ON contains(lower(text), p) UNION ALL SELECT 'txt' FROM files UNION ALL SELECT doc_id::VARCHAR || '.txt' FROM files) UNION ALL SELECT 'absent-' || i, false FROM range(20) r(i)",
    "lang_counts": fixtures.values_sql("LANGUAGES", "language, files"),
    "dir_summary": f"""WITH {_DEFS}, d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS file_count FROM files GROUP BY 1 ORDER BY 1 LIMIT 15), k AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS n FROM defs GROUP BY 1)
SELECT path, file_count, coalesce(n::VARCHAR || CASE WHEN n = 1 THEN ' function' ELSE ' functions' END, 'no code symbols') AS description FROM d LEFT JOIN k USING (path)""",
    "key_symbols": f"""WITH {_DEFS}, i AS (SELECT to_name AS name, count(*) AS callers FROM edges GROUP BY 1), o AS (SELECT from_name AS name, count(*) AS callees FROM edges GROUP BY 1)
SELECT name, path AS file, coalesce(callers, 0)::BIGINT AS callers, coalesce(callees, 0)::BIGINT AS callees, line_number AS ord FROM defs LEFT JOIN i USING (name) LEFT JOIN o USING (name) WHERE coalesce(callers, 0) + coalesce(callees, 0) > 0 ORDER BY coalesce(callers, 0) + coalesce(callees, 0) DESC, doc_id, line_number LIMIT 10""",
    "hot_spots": f"WITH {_DEFS} SELECT path AS file, count(*) AS symbols, max(n)::BIGINT AS lines FROM defs JOIN (SELECT doc_id, len(l) AS n FROM cut) USING (doc_id) GROUP BY path ORDER BY symbols DESC, lines DESC, file LIMIT 10",
    "index_stats": f"""WITH {_DEFS}, h AS (SELECT hex(encode(text)) AS h FROM files), c AS (SELECT unnest([substr(h, 512 * k + 1, 516) FOR k IN range(length(h) // 512 + 1)]) AS s FROM h), g AS (SELECT DISTINCT unnest([substr(s, 2 * i + 1, 6) FOR i IN range(greatest(length(s) // 2 - 2, 0))]) AS g FROM c),
cc AS (SELECT DISTINCT c AS concept FROM files JOIN (VALUES """ + ", ".join(f"('{k}', '{concepts.RENAMED.get(k, k)}')" for k in concepts.KEYWORDS) + """) k(p, c) ON contains(lower(text), p) UNION SELECT 'txt' UNION SELECT doc_id::VARCHAR || '.txt' FROM files)
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM g) AS trigrams, (SELECT count(*) FROM defs) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM cc) AS concepts""",
    "stale_files": f"WITH {_FILES} SELECT path, CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'new' WHEN 2 THEN 'changed' ELSE 'same' END AS state FROM files",
    "incremental_merge": f"WITH {_FILES} SELECT doc_id, path, strlen(text) + CASE WHEN doc_id % 10 IN (1, 2) THEN 8 ELSE 0 END AS bytes FROM files WHERE doc_id % 10 <> 0",
    "index_refresh": """WITH n AS (SELECT *, source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path, coalesce(text, '') || CASE WHEN doc_id % 10 = 2 THEN chr(1) ELSE '' END AS t FROM documents WHERE doc_id % 10 <> 0), h AS (SELECT path, hex(encode(t)) AS h FROM n),
c AS (SELECT path, unnest([substr(h, 512 * k + 1, 516) FOR k IN range(length(h) // 512 + 1)]) AS s FROM h), g AS (SELECT DISTINCT path, unnest([substr(s, 2 * i + 1, 6) FOR i IN range(greatest(length(s) // 2 - 2, 0))]) AS g FROM c), w AS (SELECT path, count(*) AS grams FROM g GROUP BY path)
SELECT path, strlen(t)::BIGINT AS bytes, coalesce(grams, 0) AS grams FROM n LEFT JOIN w USING (path)""",
    "debounce_sessions": """WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths, count(*) AS n_events FROM s GROUP BY user_id, k""",
    "predict_queries": """WITH p AS (SELECT DISTINCT event_type AS pattern FROM events UNION ALL VALUES ('test_click'), ('a.b')),
r AS (SELECT pattern, 'callers' AS query_type, pattern AS arg, 0.7::DOUBLE AS confidence, 'symbol search -> callers' AS reason, 0 AS turn FROM p WHERE regexp_matches(pattern, '^[A-Za-z0-9_]{3,}$')
UNION ALL SELECT pattern, 'impact', pattern, 0.4, 'symbol search -> impact analysis', 1 FROM p WHERE regexp_matches(pattern, '^[A-Za-z0-9_]{3,}$')
UNION ALL SELECT pattern, 'search', 'click', 0.75, 'test search -> source', 2 FROM p WHERE pattern = 'test_click'
UNION ALL SELECT pattern, 'search', 'handle', 0.6, 'error search -> handler', 3 FROM p WHERE contains(lower(pattern), 'error')
UNION ALL SELECT pattern, 'search', 'catch', 0.45, 'error search -> catch block', 4 FROM p WHERE contains(lower(pattern), 'error'))
SELECT pattern, query_type, arg, confidence, reason, (row_number() OVER (PARTITION BY pattern ORDER BY confidence DESC, turn))::INTEGER AS rank FROM r""",
    "manifest_deps": fixtures.values_sql("DEPENDENCIES", "path, concept"),
    "import_concepts": fixtures.values_sql("IMPORTED", "path, name"),
    "parsed_symbols": fixtures.values_sql("SYMBOLS", "path, kind, name, line_start, line_end"),
    "parsed_calls": fixtures.values_sql("CALLS", "path, callee"),
    "parsed_imports": fixtures.values_sql("IMPORTS", "path, target"),
    "code_edges": fixtures.values_sql("EDGES", "from_file, from_name, to_file, to_name"),
    "entry_points": fixtures.values_sql("ENTRY_POINTS", "path"),
    "model_dependencies": fixtures.values_sql("MODEL_DEPENDENCIES", "name"),
}
