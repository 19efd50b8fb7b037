"""Source texts -> imports, classes, functions and chunks, over Arrow batches.

One scan of a text takes its strings, templates and comments out and pairs its braces; patterns of declarations then look at
what is left, and a block ends where its brace does. Python texts go through Python's own parser; those that it rejects are
scanned like the others, with blocks by indent.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "file_id string, kind string, name string, start_line long, end_line long, parents array<string>, content string"
JS = {"import": r"^\s*import\s.+?from\s+['\"].+?['\"]|(?:\b(?:const|let|var)\s+[^=;\n]+=\s*)?\brequire\(['\"].+?['\"]\)", "class": r"\bclass\s+(\w+)", "function": r"\bfunction\s+(\w+)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"}
TS = {**JS, "class": r"\b(?:class|interface)\s+(\w+)"}
JAVA = {"import": r"^\s*import\s+[\w.*]+;", "class": r"\b(?:class|interface|enum)\s+(\w+)", "function": r"\b(?:public|private|protected)\s+(?:(?:static|final|abstract)\s+)*[\w<>\[\], ]+?\s+(\w+)\s*\("}
C = {"import": r"^\s*#include\s+[<\"].+?[>\"]", "class": r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{", "function": r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{)]*\)\s*\{"}
CPP = {**C, "class": r"\b(?:class|struct)\s+(\w+)[^;{]*\{", "function": r"^\s*[A-Za-z_][\w\s*&:<>,]*?\b(\w+)\s*\([^;{)]*\)\s*(?:const\s*)?\{"}
GO = {"import": r"^\s*import\s+(?:\([^)]*\)|\".+?\")", "class": r"^type\s+(\w+)\s+(?:struct|interface)", "function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("}
RUST = {"import": r"^\s*use\s+[^;]+;", "class": r"\b(?:struct|enum|trait|impl)\s+(\w+)", "function": r"\bfn\s+(\w+)"}
RUBY = {"import": r"^\s*require(?:_relative)?\s+['\"].+?['\"]", "class": r"^\s*(?:class|module)\s+(\w+)", "function": r"^\s*def\s+(?:self\.)?(\w+[?!]?)"}
PHP = {"import": r"^\s*use\s+[^;]+;", "class": r"\b(?:class|interface|trait)\s+(\w+)", "function": r"\bfunction\s+(\w+)\s*\("}
CSHARP = {"import": r"^\s*using\s+[\w.]+;", "class": r"\b(?:class|interface|struct|record)\s+(\w+)", "function": r"\b(?:public|private|protected|internal)\s+(?:(?:static|async|override|virtual)\s+)*[\w<>\[\], ]+?\s+(\w+)\s*\("}
PATTERNS = {"javascript": JS, "typescript": TS, "java": JAVA, "c": C, "cpp": CPP, "go": GO, "rust": RUST, "ruby": RUBY, "php": PHP, "csharp": CSHARP}


PYTHON = {"import": r"^[ \t]*(?:import|from)[ \t][^\n;]+", "class": r"^[ \t]*class[ \t]+(\w+)", "function": r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"}
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
#: By language: what opens a comment to the end of the line, whether /* */ is one, strings, whether `${}` templates exist.
SLASHES = ("//", True, _QUOTED, False)
STYLES = {
    "javascript": ("//", True, _QUOTED, True), "typescript": ("//", True, _QUOTED, True), "java": ("//", True, r'"""[\s\S]*?"""|' + _QUOTED, False),
    "go": ("//", True, _QUOTED + "|`[^`]*`", False), "rust": ("//", True, r"r(?P<hash>#*)\"[\s\S]*?\"(?P=hash)|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]{1,9}?|[^'\\\n])'", False),
    "csharp": ("//", True, '@"(?:""|[^"])*"|' + _QUOTED, False), "php": ("//|#", True, r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", False),
    "ruby": ("#", False, r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", False), "python": ("#", False, r"\"\"\"(?:\\.|[^\\])*?\"\"\"|\'\'\'(?:\\.|[^\\])*?\'\'\'|" + _QUOTED, False),
}
#: Behind these a slash begins a regular expression, not a division.
BEFORE_REGEX = "(,=:[!&|?{};\n"
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])*/")


class Scan(NamedTuple):
    """code: the text with strings (but for their quotes) and comments blanked, as long as the text; opens, closes: the places
    of paired braces, by the opening one (an unclosed one closes at the end); comments, strings: (start, end)."""

    code: str
    opens: list[int]
    closes: list[int]
    comments: list[tuple[int, int]]
    strings: list[tuple[int, int]]


def scan(text: str, language: str) -> Scan:
    """One pass over a text. Templates nest: code inside `${}` is code, and may hold templates."""
    line, block, quoted, template = STYLES.get(language, SLASHES)
    token = re.compile("(?P<comment>(?:" + line + r")[^\n]*" + (r"|/\*[\s\S]*?(?:\*/|\Z)" if block else "") + ")|(?P<string>" + quoted + r")|(?P<brace>[{}])" + (r"|(?P<tick>`)|(?P<slash>/)" if template else ""), re.S if language == "python" else 0)
    inside = re.compile(r"\\.|(?P<end>`)|(?P<into>\$\{)", re.S)
    pairs, comments, strings, blank, stack = {}, [], [], [], []
    i, begun = 0, 0
    while True:
        m = (inside if stack and stack[-1] == "`" else token).search(text, i)
        if not m:
            break
        i, kind = m.end(), m.lastgroup
        if m.re is inside:
            if kind:
                blank.append((begun, m.start()))
                stack.pop() if kind == "end" else stack.append("${")
        elif kind == "comment":
            comments.append(m.span())
            blank.append(m.span())
        elif kind == "brace" and m.group() == "{":
            stack.append(m.start())
        elif kind == "brace":
            if stack and stack[-1] == "${":
                stack.pop()
                begun = i
            elif stack:
                pairs[stack.pop()] = m.start()
        elif kind == "tick":
            stack.append("`")
            begun = i
        elif kind == "slash":
            before = text[:m.start()].rstrip(" \t")[-1:] if m.start() < 200 else text[m.start() - 200 : m.start()].rstrip(" \t")[-1:]
            found = REGEX.match(text, m.start()) if not before or before in BEFORE_REGEX else None
            if found:
                blank.append((m.start() + 1, found.end() - 1))
                i = found.end()
        else:  # a string; a group inside its pattern may be the last one
            strings.append(m.span())
            blank.append((m.start() + 1, max(m.start() + 1, m.end() - 1)))
    if stack and stack[-1] == "`":
        blank.append((begun, len(text)))
    pairs.update((x, len(text)) for x in stack if isinstance(x, int))
    code, at = [], 0
    for a, b in blank:
        code += [text[at:a], re.sub(r"[^\n]", "_" if text[a - 1 : a] in ("'", '"', "`") else " ", text[a:b])]
        at = b
    opens = sorted(pairs)
    return Scan("".join(code) + text[at:], opens, [pairs[x] for x in opens], comments, strings)


def parse_python(text: str) -> list[tuple]:
    """(kind, name, start, end, parents, content), parents innermost first; a text that does not parse is scanned."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return parse_patterns(text, "python")
    rows, all_lines = [], text.split("\n")

    def visit(node: ast.AST, parents: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            kind = {"ClassDef": "class", "FunctionDef": "function", "AsyncFunctionDef": "function", "Import": "import", "ImportFrom": "import"}.get(type(child).__name__)
            if kind:
                content = "\n".join(all_lines[child.lineno - 1 : child.end_lineno])
                name = content.strip() if kind == "import" else child.name
                rows.append(("method" if kind == "function" and parents else kind, name, child.lineno, child.end_lineno, parents[:], content))
            visit(child, [child.name, *parents] if kind == "class" else parents)

    try:
        visit(tree, [])
    except RecursionError:
        return parse_patterns(text, "python")
    return rows


def brace_end(s: Scan, at: int) -> int:
    """Where the block ends that opens behind a place: its closing brace, or the end of the line where none opens before a ;."""
    k = bisect_left(s.opens, at)
    if k < len(s.opens) and s.code.find(";", at, s.opens[k]) < 0:
        return min(s.closes[k] + 1, len(s.code))
    stop = s.code.find("\n", at)
    return len(s.code) if stop < 0 else stop


def ruby_end(s: Scan, at: int) -> int:
    """The end of a block that is closed by an `end` at its own indent."""
    begin = s.code.rfind("\n", 0, at) + 1
    indent = re.compile(r"[ \t]*").match(s.code, begin).group()
    m = re.compile(rf"^{indent}end\b", re.M).search(s.code, at)
    return m.end() if m else len(s.code)


def indent_end(s: Scan, at: int) -> int:
    """The end of a block that goes on while lines are indented deeper than its first."""
    begin = s.code.rfind("\n", 0, at) + 1
    deep = len(re.compile(r"[ \t]*").match(s.code, begin).group())
    m = re.compile(rf"\n[ \t]{{0,{deep}}}(?=[^ \t\r\n])").search(s.code, at)
    return len((s.code[: m.start()] if m else s.code).rstrip())


ENDS = {"ruby": ruby_end, "python": indent_end}


def parse_patterns(text: str, language: str) -> list[tuple]:
    """(kind, name, start, end, parents, content) in the order of the text; parents are the classes around, innermost first."""
    patterns = PYTHON if language == "python" else PATTERNS.get(language)
    if not patterns:
        return []
    s, found = scan(text, language), []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, s.code, re.M):
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            name = next((g for g in m.groups() if g), text[at : m.end()].strip())
            end = m.end() if kind == "import" else ENDS.get(language, brace_end)(s, at)
            found.append((at, -end, kind, name))
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    rows, line = [], lambda i: bisect_right(breaks, i - 1) + 1
    around: list[tuple[int, str]] = []
    for at, end, kind, name in sorted(found):
        around = [x for x in around if x[0] >= -end]
        parents = [x[1] for x in reversed(around)]
        rows.append(("method" if kind == "function" and parents else kind, name, line(at), line(-end), parents, text[at:-end]))
        if kind == "class":
            around.append((-end, name))
    return rows


def rows_of(text: str, language: str) -> list[tuple]:
    return parse_python(text) if language == "python" else parse_patterns(text, language)


def symbol_table(parsed: DataFrame) -> DataFrame:
    """file_id, name, lines: all lines that define a name."""
    d = parsed.where(F.col("kind").isin("class", "function", "method"))
    return d.groupBy("file_id", "name").agg(F.sort_array(F.collect_list("start_line")).alias("lines"))


def nodes_of(parsed: DataFrame, *kinds: str) -> DataFrame:
    """The rows of some kinds with their place in the order of the text (outer ones first)."""
    w = Window.partitionBy("file_id").orderBy("start_line", F.desc("end_line"), "name")
    return parsed.where(F.col("kind").isin(*kinds)).withColumn("rank", F.row_number().over(w).cast("long"))


def parse(docs: DataFrame) -> DataFrame:
    """docs (file_id, language, text) -> SCHEMA, and a module row for each text without a definition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, lang, text in zip(pdf.file_id, pdf.language, pdf.text, strict=True):
                text = text or ""
                rows = rows_of(text, lang)
                if not any(r[0] in ("class", "function", "method") for r in rows):
                    rows.append(("module", f, 1, text.count("\n") + 1, [], text))
                out += [(f, *r) for r in rows]
            yield pd.DataFrame(out, columns=["file_id", "kind", "name", "start_line", "end_line", "parents", "content"])

    return docs.select("file_id", "language", "text").mapInPandas(run, SCHEMA)
