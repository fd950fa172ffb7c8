"""Find declarations and calls in a file's bytes."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from typing import NamedTuple


class Symbol(NamedTuple):
    kind: str
    name: str
    byte_start: int
    byte_end: int
    line_start: int
    line_end: int


class Call(NamedTuple):
    name: str
    at: int


#: Declarations over more lines than this aren't symbols; what they hold is.
MOST_LINES = 500
ANONYMOUS = "<anonymous>"
_W = rb"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"


def _form(pattern: bytes, kind: str, body: str = "brace") -> tuple[re.Pattern, str, str]:
    """A declaration: where it starts, its kind, and what ends it. A group `n` holds the name."""
    return re.compile(rb"(?m)^[ \t]*+" + pattern.replace(b"NAME", b"(?P<n>" + _W + b")")), kind, body


_MODS = rb"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|partial|open|export|default|declare|const|unsafe|extern|pub(?:\([^)]*\))?|inline|readonly|implicit|lazy|case|synchronized|native|fileprivate|mutating|data)\s+(?:\"[^\"]*\"\s+)?)*"
#: A type and a name, with or without a body; a constructor has no type and is none.
_TYPED = _MODS + rb"+(?:<[^>\n]*>\s*)?(?!(?:return|new|else|throw|if|while|for|switch|await|yield|assert|case|goto|using|delegate|do|try|in|is|package|import|namespace)\b)[\w.$<>\[\],? \x80-\xff]*?[\w>\]]\s+NAME\s*"
_JAVA_METHOD = _TYPED + rb"\([^;{}]*\)[^;{}=]*(?=\{)"
_JAVA_BODILESS = _TYPED + rb"\([^;{}=]*\)(?:\s*throws\s[^;{}()=]*|\s*=>[^;{}]*)?\s*(?=;)"
_C_FUNCTION = rb"(?!return\b|else\b|if\b|while\b|for\b|switch\b|do\b|typedef\b|struct\b[^(]*\{)[\w:<>,*&~ \t\x80-\xff]*?[\w>*&][\s*&]+(?P<n>[\w:~\x80-\xff]+)\s*\([^;{}]*\)[^;{}()]*(?=\{)"
_SCRIPT = [
    _form(rb"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*NAME", "function"),
    _form(rb"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+NAME", "class"),
    _form(rb"(?:export\s+)?(?:const|let)\s+NAME", "function", "statement"),
    _form(rb"(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|else\b|with\b)(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?NAME\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{;=]+)?(?=\{)", "method"),
]
FORMS: dict[str, list[tuple[re.Pattern, str, str]]] = {
    "rust": [_form(_MODS + rb"fn\s+NAME", "function"), _form(_MODS + rb"struct\s+NAME", "struct", "item"), _form(_MODS + rb"enum\s+NAME", "enum"), _form(_MODS + rb"trait\s+NAME", "trait"), _form(rb"(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?(?P<n>[\w:<>&', ]+?)\s*(?:where[^{]*)?(?=\{)", "impl"), _form(_MODS + rb"mod\s+NAME", "module", "item")],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": [_form(rb"func\s+NAME", "function"), _form(rb"func\s*\([^)]*\)\s*NAME", "method"), _form(rb"type\s+NAME", "struct", "item")],
    "java": [_form(_MODS + rb"class\s+NAME", "class"), _form(_MODS + rb"interface\s+NAME", "interface"), _form(_MODS + rb"enum\s+NAME", "enum"), _form(_JAVA_METHOD, "method"), _form(_JAVA_BODILESS, "method", "bodiless")],
    "c": [_form(_C_FUNCTION, "function"), _form(rb"(?:typedef\s+)?struct\s+NAME\s*(?=\{)", "struct"), _form(rb"(?:typedef\s+)?enum\s+NAME\s*(?=\{)", "enum")],
    "cpp": [_form(_C_FUNCTION, "function"), _form(rb"(?:template\s*<[^>]*>\s*)?class\s+NAME[^;{}()]*(?=\{)", "class"), _form(rb"(?:typedef\s+)?struct\s+NAME[^;{}()]*(?=\{)", "struct"), _form(rb"(?:typedef\s+)?enum\s+(?:class\s+)?NAME[^;{}()]*(?=\{)", "enum")],
    "ruby": [_form(rb"def\s+(?:self\.)?(?P<n>\w+[?!=]?)", "method", "end"), _form(rb"class\s+NAME", "class", "end"), _form(rb"module\s+NAME", "module", "end")],
    "php": [_form(_MODS + rb"function\s+&?NAME", "function"), _form(_MODS + rb"class\s+NAME", "class"), _form(rb"interface\s+NAME", "interface"), _form(rb"trait\s+NAME", "trait"), _form(rb"enum\s+NAME", "enum")],
    "swift": [_form(_MODS + rb"func\s+NAME", "function"), _form(_MODS + rb"class\s+NAME", "class"), _form(_MODS + rb"struct\s+NAME", "struct"), _form(_MODS + rb"protocol\s+NAME", "interface"), _form(_MODS + rb"enum\s+NAME", "enum")],
    "csharp": [_form(_MODS + rb"class\s+NAME", "class"), _form(_MODS + rb"interface\s+NAME", "interface"), _form(_MODS + rb"struct\s+NAME", "struct"), _form(_MODS + rb"enum\s+NAME", "enum"), _form(_JAVA_METHOD, "method"), _form(_JAVA_BODILESS, "method", "bodiless")],
    "scala": [_form(_MODS + rb"def\s+NAME", "function", "item"), _form(_MODS + rb"class\s+NAME", "class", "item"), _form(_MODS + rb"object\s+NAME", "class", "item"), _form(_MODS + rb"trait\s+NAME", "trait", "item")],
    "lua": [_form(rb"(?:local\s+)?function\s+(?P<n>[\w.:]+)", "function", "end")],
    "zig": [_form(_MODS + rb"fn\s+NAME", "function")],
    "bash": [_form(rb"(?:function\s+(?P<n>[\w-]+)\s*(?:\(\s*\))?|(?P<m>[\w-]+)\s*\(\s*\))\s*(?=\{)", "function")],
    "hcl": [_form(rb"(?P<n>\w+)(?:[ \t]+(?:\"[^\"\n]*\"|\w+))*[ \t]*(?=\{)", "function")],
}
_LINE_COMMENT = {"ruby": rb"#", "bash": rb"(?<![\w$])#", "hcl": rb"#|//", "php": rb"#|//", "lua": rb"--(?!\[\[)", "python": rb"#"}
_BLOCK_COMMENT = {"lua": rb"--\[\[.*?(?:\]\]|\Z)", "ruby": rb"^=begin\b.*?^=end\b", "bash": rb"(?!)", "zig": rb"(?!)", "python": rb"(?!)"}
_CONTROL = frozenset("if for while switch catch return else elif do match loop unless until when".split())
#: Words before a parenthesis that aren't called.
_KEYWORDS = _CONTROL | frozenset("function sizeof and or not in is assert del lambda yield await new throw case super typeof fn func foreach isset unset alignof decltype static_assert synchronized using nameof".split())


def blank(src: bytes, lang: str) -> bytes:
    """src with comments and strings as spaces, byte for byte."""
    strings = rb"\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`" if lang in ("javascript", "typescript", "go") else rb"\"(?:\\.|[^\"\\])*\"" if lang in ("ruby", "bash", "php", "rust") else rb"\"(?:\\.|[^\"\\\n])*\""
    quote = rb"'(?:\\[^\n]{1,8}|[^'\\\n])'" if lang in ("rust", "c", "cpp", "java", "csharp", "go", "swift", "scala", "zig") else rb"'(?:\\.|[^'\\\n])*'"
    if lang == "hcl":
        quote = rb"(?!)"
    parts = [_BLOCK_COMMENT.get(lang, rb"/\*.*?(?:\*/|\Z)"), rb"(?:" + _LINE_COMMENT.get(lang, rb"//") + rb")[^\n]*", strings, quote]
    return re.sub(rb"(?ms)" + b"|".join(parts), lambda m: re.sub(rb"[^\n]", b" ", m[0]), src)


def _brace_ends(code: bytes) -> dict[int, int]:
    """Where each opening brace is closed."""
    ends, held = {}, []
    for m in re.finditer(rb"[{}]", code):
        if m[0] == b"{":
            held.append(m.start())
        elif held:
            ends[held.pop()] = m.end()
    return ends | {at: len(code) for at in held}


_OPENS = re.compile(rb"\b(?:class|module|def|function|begin|case|do|end)\b|(?m:^[ \t]*(?:if|unless|while|until|for)\b)|\bthen\b|\bfor\b|\bwhile\b|\brepeat\b|\buntil\b|\bif\b")


def _word_end(code: bytes, at: int, lang: str) -> int:
    """Where the `end` of the block that begins at `at` stops."""
    depth, loop = 0, False
    opening = {b"function", b"do", b"if", b"repeat"} if lang == "lua" else {b"class", b"module", b"def", b"begin", b"case", b"do"}
    for m in _OPENS.finditer(code, at):
        word = m[0].strip()
        if lang != "lua" and word in (b"if", b"unless", b"while", b"until", b"for"):
            if m[0] == word and (m.start() and code[m.start() - 1 : m.start()] != b"\n"):
                continue  # behind a statement
            depth += 1
            loop = word in (b"while", b"until", b"for")
        elif word == b"end" or lang == "lua" and word == b"until":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif word in opening:
            if word == b"do" and loop and lang != "lua":
                loop = False
                continue
            depth += 1
    return len(code)


def symbols(src: bytes, lang: str) -> list[Symbol]:
    """The declarations of a file, by their start, outer ones first."""
    if lang == "python":
        found = _python(src)[0]
    elif lang in FORMS:
        found = _scanned(src, lang)
    else:
        return []
    lines = [0, *(m.end() for m in re.finditer(rb"\n", src))]
    out = []
    for kind, name, start, end in sorted(set(found), key=lambda s: (s[2], -s[3])):
        first, last = bisect_right(lines, start), bisect_right(lines, max(start, end - 1))
        if last - first < MOST_LINES:
            out.append(Symbol(kind, name, start, end, first, last))
    return out


def _scanned(src: bytes, lang: str) -> list[tuple[str, str, int, int]]:
    code = src if lang == "hcl" else blank(src, lang)
    ends = _brace_ends(blank(src, lang))
    opens = sorted(ends)
    found: dict[int, tuple[str, str, int, int]] = {}
    for pattern, kind, body in FORMS[lang]:
        for m in pattern.finditer(code):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            groups = m.groupdict()
            raw = next((g for g in groups.values() if g), b"")
            name = raw.decode("utf-8", "replace").strip() or ANONYMOUS
            if name in _CONTROL:
                continue
            at = bisect_right(opens, m.end() - 1)
            brace = opens[at] if at < len(opens) else len(code)
            stop = code.find(b";", m.end())
            line = code.find(b"\n", m.end())
            line = len(code) if line < 0 else line
            if body == "bodiless":
                end = stop + 1
            elif body == "end":
                end = _word_end(code, start, lang)
            elif body == "statement":
                end = stop + 1 if 0 <= stop < brace else ends.get(brace, line) if brace < line else line
            elif 0 <= stop < brace and body != "item" and lang != "go":
                if kind == "method":
                    continue
                end = stop + 1
            elif body == "item" and (brace >= len(code) or brace > line and code[m.end() : line].strip().endswith((b";", b")")) or 0 <= stop < brace):
                end = stop + 1 if 0 <= stop < brace else line
            else:
                end = ends.get(brace, line)
            found.setdefault(start, (kind, name, start, end))
    return _methods(found) if lang == "php" else list(found.values())


def _methods(found: dict[int, tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """A function right within a class or its like is a method."""
    out, around = [], []
    for kind, name, start, end in sorted(found.values(), key=lambda s: (s[2], -s[3])):
        while around and around[-1][1] <= start:
            around.pop()
        inner = bool(around) and around[-1][0] not in ("function", "method")
        out.append(("method" if kind == "function" and inner else kind, name, start, end))
        around.append((out[-1][0], end))
    return out


def _python(src: bytes) -> tuple[list[tuple[str, str, int, int]], list[Call]]:
    starts = [0, *(m.end() for m in re.finditer(rb"\n", src))]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(src), _called(src, "python")
    found, calls = [], []
    at = lambda line, col: starts[line - 1] + col  # noqa: E731  columns of ast are bytes
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)))
        elif isinstance(node, ast.Call):
            start, end = at(node.func.lineno, node.func.col_offset), at(node.func.end_lineno, node.func.end_col_offset)
            calls.append(Call(src[start:end].decode("utf-8", "replace").rsplit(".", 1)[-1], start))
    return found, sorted(calls, key=lambda c: c.at)


def _indented(src: bytes) -> list[tuple[str, str, int, int]]:
    """Python that doesn't parse: a declaration ends before the next line that isn't indented more."""
    found = []
    for m in re.finditer(rb"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d][\w\x80-\xff]*)", src):
        after = re.compile(rb"(?m)^(?!" + re.escape(m[1]) + rb"[ \t])(?![ \t]*(?:#|$))").search(src, src.find(b"\n", m.end()) + 1 or len(src))
        end = after.start() if after else len(src)
        end = m.start() + len(src[m.start() : end].rstrip())
        found.append(("class" if m[2] == b"class" else "function", m[3].decode("utf-8", "replace"), m.end(1), end))
    return found


_CALL = re.compile(rb"(?P<n>" + _W + rb"(?:(?:\.|::|->|\?\.|\\)" + _W + rb")*)(?P<bang>!)?\s*(?:::<[^>()]*>)?\(")
_DECLARES = re.compile(rb"(?:\b(?:fn|func|def|function|class|struct|interface|enum|trait|new)\s+|\bfunc\s*\([^)]*\)\s*)$")


#: A constructor: a name alone before its parameters and body.
_CONSTRUCTOR = re.compile(rb"(?m)^[ \t]*+" + _MODS + rb"+(?P<n>" + _W + rb")\s*\([^;{}()]*\)[^;{}=]*(?=\{)")


def calls(src: bytes, lang: str) -> list[Call]:
    """The names that a file calls and where: the last part behind a dot (for C and C++ behind ::); Rust keeps its :: paths."""
    if lang == "python":
        return _python(src)[1]
    return _called(src, lang) if lang in FORMS and lang != "hcl" else []


def _called(src: bytes, lang: str) -> list[Call]:
    code = blank(src, lang)
    if lang == "bash":
        return [Call(m[1].decode("utf-8", "replace"), m.start(1)) for m in re.finditer(rb"(?m)(?:^|[;|&({`]|\$\(|\b(?:then|do|else)\b)[ \t]*([A-Za-z_./][\w./-]*)(?=[ \t\n;|&)]|\Z)", code) if m[1].decode() not in ("if", "then", "else", "fi", "for", "while", "do", "done", "case", "esac", "function", "in")]
    declared = {start for _, _, start, _ in _scanned(src, lang)} if lang != "python" else set()
    heads = sorted(declared)
    constructors = {m.start("n") for m in _CONSTRUCTOR.finditer(code) if m["n"].decode("utf-8", "replace") not in _KEYWORDS} if lang in ("java", "csharp") else set()
    found = []
    for m in _CALL.finditer(code):
        name = m["n"].decode("utf-8", "replace")
        if m["bang"] and lang != "rust" or m.start() in constructors:
            continue
        before = code[max(0, m.start() - 120) : m.start()]
        if _DECLARES.search(before) and not before.rstrip().endswith(b"new"):
            continue
        if lang in ("java", "csharp", "c", "cpp", "javascript", "typescript", "bash"):
            i = bisect_right(heads, m.start()) - 1
            if i >= 0 and b"{" not in code[heads[i] : m.start()] and b"(" not in code[heads[i] : m.start()] and b"=" not in code[heads[i] : m.start()] and b";" not in code[heads[i] : m.start()]:
                continue  # the declaration's own name
        if lang in ("c", "cpp"):
            name = name.rsplit("::", 1)[-1]
        elif lang == "php":
            name = re.split(r"->|::", name)[-1].rsplit("\\", 1)[-1]
        else:
            name = re.split(r"\?\.|\.", name)[-1]
        if name not in _KEYWORDS:
            found.append(Call(name, m.start()))
    return found


def imports(src: bytes, lang: str) -> list[str]:
    """What a file imports, in the form of its language: a path for Python's `from`, the quoted source for scripts and Go, the whole `use` for Rust."""
    text = src.decode("utf-8", "replace")
    if lang == "python":
        return [m[1].replace(".", "/") + ".py" for m in re.finditer(r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b", text)]
    if lang in ("javascript", "typescript"):
        return [m[2] for m in re.finditer(r"(?m)^[ \t]*import\b(?:[^'\";]*?\bfrom\b)?[ \t\n]*(['\"])([^'\"\n]*)\1", text)]
    if lang == "go":
        found = []
        for m in re.finditer(r'(?m)^import[ \t]+(?:\(([^)]*)\)|(?:[\w.]+[ \t]+)?"([^"\n]*)")', text):
            found += [m[2]] if m[2] is not None else re.findall(r'"([^"\n]*)"', m[1])
        return found
    if lang == "rust":
        return [m[0].strip() for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use\b[^;]*;", text)]
    return []
