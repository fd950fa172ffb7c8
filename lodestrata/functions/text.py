"""Column expressions over paths, lines and bodies. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the language each stands for.
EXTENSIONS = {
    "rs": "rust",
    "py": "python",
    "pyi": "python",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "go": "go",
    "java": "java",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "hh": "cpp",
    "hxx": "cpp",
    "rb": "ruby",
    "rake": "ruby",
    "gemspec": "ruby",
    "php": "php",
    "phtml": "php",
    "swift": "swift",
    "cs": "csharp",
    "scala": "scala",
    "sc": "scala",
    "lua": "lua",
    "zig": "zig",
    "sh": "bash",
    "bash": "bash",
    "zsh": "bash",
    "html": "html",
    "htm": "html",
    "css": "css",
    "scss": "css",
    "sass": "css",
    "json": "json",
    "jsonc": "json",
    "toml": "toml",
    "yaml": "yaml",
    "yml": "yaml",
    "tf": "hcl",
    "hcl": "hcl",
}
# File names that are taken for a program's start.
ENTRY_POINTS = ("main.rs", "main.py", "main.go", "main.ts", "main.js", "index.ts", "index.js", "app.py", "server.py", "Main.java", "main.c", "main.cpp")
# Extensions and the language name that a summary lists for them.
DEPENDENCY_NAMES = {"rs": "Rust", "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "go": "Go", "java": "Java", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "hpp": "C++"}
#: Kinds whose signature ends before the first brace.
BRACED_KINDS = ("function", "method", "struct", "class", "trait", "interface")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one, or if only a leading dot is there."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def directory(path: Column) -> Column:
    """The path without its last step; . for the top."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(up == "", F.lit(".")).otherwise(up)


def language(path: Column) -> Column:
    return _lookup(EXTENSIONS, F.coalesce(extension(path), F.lit("")))


def dependency_name(path: Column) -> Column:
    return _lookup(DEPENDENCY_NAMES, F.coalesce(extension(path), F.lit("")))


def is_entry_point(path: Column) -> Column:
    return file_name(path).isin(*ENTRY_POINTS)


def lossy_text(content: Column) -> Column:
    """Bytes as text, invalid ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column, sniff: int = 8192) -> Column:
    """A zero byte among the first ones."""
    return F.contains(F.substring(content, 1, sniff), F.lit(bytearray(b"\0")))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def tokens(s: Column) -> Column:
    """A model's tokens, taken for four bytes each."""
    return F.ceil(F.octet_length(s) / 4).cast("int")


def signature(body: Column, kind: Column) -> Column:
    first = F.substring_index(body, "\n", 1)
    return F.trim(F.when(kind.isin(*BRACED_KINDS), F.substring_index(first, "{", 1)).otherwise(first))


def body(text: Column, start: Column, end: Column) -> Column:
    """The text from byte `start` up to byte `end`."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def quoted_list(items: Column) -> Column:
    """["a", "b"], with quotes and backslashes escaped; [] for null."""
    one = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(items, one), ", "), F.lit("")), F.lit("]"))


def likely_symbol(pattern: Column) -> Column:
    """Three bytes or more, letters, digits and underscores only."""
    return (F.octet_length(pattern) >= 3) & pattern.rlike(r"^[\p{IsAlphabetic}\p{N}_]+$")


def pack(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


def unpack(gram: int) -> bytes:
    return gram.to_bytes(3, "big")
