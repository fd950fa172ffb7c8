"""A summary of a whole corpus: languages, directories, key symbols, entry points, dependencies, hot spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIRECTORIES, KEY_SYMBOLS, HOT_SPOTS = 15, 10, 10


def languages(files: DataFrame) -> DataFrame:
    """language, files; a file of no known language counts by its extension, or as other."""
    name = F.coalesce(T.language(F.col("path")), T.extension(F.col("path")), F.lit("other"))
    return files.select(name.alias("language")).groupBy("language").agg(F.count("*").alias("files"))


def directories(files: DataFrame, symbols: DataFrame, most: int = DIRECTORIES) -> DataFrame:
    """path, file_count, description of the first directories by path; described by the numbers of their kinds of symbols."""
    d = files.groupBy(T.directory(F.col("path")).alias("path")).agg(F.count("*").alias("file_count")).orderBy("path").limit(most)
    kinds = symbols.groupBy(T.directory(F.col("path")).alias("dir"), "kind").agg(F.count("*").alias("n"))
    said = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("kind"), F.when(F.col("n") == 1, "").otherwise("s"))
    described = kinds.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list(said)), ", ").alias("description"))
    return d.join(described, F.col("path") == F.col("dir"), "left").select("path", "file_count", F.coalesce("description", F.lit("no code symbols")).alias("description"))


def key_symbols(symbols: DataFrame, degrees: DataFrame, most: int = KEY_SYMBOLS) -> DataFrame:
    """kind, name, file, callers, callees, rank of the symbols with the most edges; of equal ones the first. degrees: name, callers, callees."""
    s = symbols.select("doc_id", "ord", "path", "kind", "name").join(degrees, "name")
    top = s.orderBy(F.desc(F.col("callers") + F.col("callees")), "doc_id", "ord").limit(most)
    return top.select("kind", "name", F.col("path").alias("file"), "callers", "callees", "doc_id", "ord")


def entry_points(files: DataFrame) -> DataFrame:
    return files.where(T.is_entry_point(F.col("path"))).select("path")


def dependencies(files: DataFrame) -> DataFrame:
    name = T.dependency_name(F.col("path"))
    return files.select(name.alias("name")).where("name is not null").distinct()


def hot_spots(files: DataFrame, symbols: DataFrame, most: int = HOT_SPOTS) -> DataFrame:
    """file, symbols, lines of the files with the most symbols, then the most lines."""
    n = symbols.groupBy("doc_id").agg(F.count("*").alias("symbols"))
    sizes = files.select("doc_id", F.col("path").alias("file"), T.line_count(F.col("text")).cast("long").alias("lines"))
    return sizes.join(n, "doc_id").orderBy(F.desc("symbols"), F.desc("lines"), "file").limit(most).select("file", "symbols", "lines")


def build(files: DataFrame, symbols: DataFrame, degrees: DataFrame) -> dict:
    """The summary's parts as lists of dictionaries, and its text and tokens. Every part but languages, entry points and dependencies has a fixed length."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    model = {
        "languages": rows(languages(files).orderBy(F.desc("files"), "language")),
        "structure": sorted(rows(directories(files, symbols)), key=lambda r: r["path"]),
        "key_symbols": rows(key_symbols(symbols, degrees)),
        "entry_points": [r.path for r in entry_points(files).orderBy("path").collect()],
        "dependencies": [r.name for r in dependencies(files).orderBy("name").collect()],
        "hot_spots": rows(hot_spots(files, symbols)),
    }
    said = render(model)
    return model | {"text": said, "tokens": -(-len(said.encode()) // 4)}


#: The sections in their order, with title, part, how a row is said, whether an empty one is shown, whether a blank line follows.
SECTIONS = (
    ("Languages", "languages", lambda r: f"{r['language']}: {r['files']} files", True, True),
    ("Structure", "structure", lambda r: f"{r['path']} ({r['file_count']} files) -- {r['description']}", True, True),
    ("Key Abstractions", "key_symbols", lambda r: f"{r['kind']} {r['name']} ({r['file']}) -- {r['callers']} callers, {r['callees']} callees", False, True),
    ("Entry Points", "entry_points", str, False, True),
    ("Dependencies", "dependencies", str, False, True),
    ("Hot Spots (most complex)", "hot_spots", lambda r: f"{r['file']} ({r['symbols']} symbols, {r['lines']} lines)", False, False),
)


def render(model: dict) -> str:
    said = "# Codebase Mental Model\n\n"
    for title, part, line, always, gap in SECTIONS:
        if always or model[part]:
            said += f"## {title}\n" + "".join(f"- {line(r)}\n" for r in model[part]) + "\n" * gap
    return said


def stats(files: DataFrame, postings: DataFrame, symbols: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row of counts. edges: their number, as graph.edge_count() gives it."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(files, "files"), postings.agg(F.countDistinct("gram").alias("trigrams")), count(symbols, "symbols"), edges, concepts.agg(F.count("*").alias("concept_insertions"), F.countDistinct("concept").alias("concepts"))]
    out = parts[0].withColumn("__k", F.lit(0))
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p.withColumn("__k", F.lit(0))), "__k")
    return out.drop("__k")
