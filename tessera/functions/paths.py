"""Expressions over paths and identifiers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin",
    "md": "markdown", "txt": "text", "html": "html", "css": "css", "sql": "sql", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}
#: Category -> substrings of the lower-cased path; the first category that has one wins.
CATEGORIES = {"core": ["core", "src", "lib", "main"], "api": ["api", "endpoint", "route"], "models": ["model", "schema", "entity"], "services": ["service", "business", "logic"], "utils": ["util", "helper", "common"], "tests": ["test", "spec"], "config": ["config", "setting"], "docs": ["doc", "readme"]}

#: What names say where no category does.
NAMED = {"tests": "test_|_test|spec_|_spec", "config": r"\.conf|\.config|\.yaml|\.yml|\.json", "docs": r"\.md$|\.rst$|\.txt$"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column, languages: Mapping[str, str] = LANGUAGES) -> Column:
    return F.create_map(*(F.lit(x) for kv in languages.items() for x in kv))[suffix(path)]


def category(path: Column, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> Column:
    """The first category with a part of it in the path; else, by the name, tests, config or docs; else other."""
    p, out = F.lower(path), None
    for name, parts in categories.items():
        hit = p.rlike("|".join(map(re.escape, parts)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, pattern in NAMED.items():
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("other")


def parent(path: Column) -> Column:
    """The directory's own name, or root."""
    parts = F.split(path, "/")
    return F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("root"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def normalize(path: Column, root: str | None = None) -> Column:
    """POSIX path without ., .. and empty parts; relative to root if it is inside."""

    def fold(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        return F.when(part.isin("", "."), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), fold), "/")
    full = F.concat(F.when(path.startswith("/"), "/").otherwise(""), folded)
    return full if root is None else F.regexp_replace(full, "^" + re.escape(root.rstrip("/")) + "/", "")


def chunk_id(file: Column, start: Column, end: Column) -> Column:
    return F.concat(file, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def symbol_id(file: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.concat_ws("::", file, kind, name, F.concat(F.lit("L"), line.cast("string")))


def ancestors(path: Column) -> Column:
    """All directories above, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def glob_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regular expression, negated, directories only) of an ignore pattern; a pattern without a slash names a part at any depth."""
    negated = pattern.startswith("!")
    p = pattern[negated:]
    only_dirs, p = p.endswith("/"), p.rstrip("/")
    anchored = "/" in p
    out, i = "", 0
    p = p.lstrip("/")
    while i < len(p):
        if p[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif p[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i:]:
            j = p.index("]", i)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dirs else "(?:/|$)"), negated, only_dirs


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Does the last pattern that matches exclude? Blank lines and comments do not count."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            expr, negated, _ = glob_regex(p.strip())
            out = F.when(path.rlike(expr), F.lit(not negated)).otherwise(out)
    return out


def fnmatch(path: Column, pattern: str) -> Column:
    import fnmatch as fm

    return path.rlike("^" + fm.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$")
