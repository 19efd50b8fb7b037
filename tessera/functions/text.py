"""Expressions over texts: tokens, counts, queries, links, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
ACCENTED, PLAIN = "äçèéêíñóöü", "aceeeinoou"
#: Intents in order of precedence, each with patterns between word boundaries, in lower case.
INTENTS = {
    "architectural": ["architecture|design|structure|overview|how.*work|organization", "system|module|component|relationship|dependency", "flow|process|pattern|framework", "where.*defined|where.*located|where.*find|location.*of", "which.*file|what.*file|file.*contain", r"what.*defined|what.*functions|what.*classes|what.*in.*\.py", r"cli\.py|main\.py|app\.py|server\.py"],
    "implementation": ["implement|code|algorithm|function|method|class", "how.*implement|how.*code|how.*build", "detail|specific|actual|concrete"],
    "usage": ["how.*use|how.*call|example|usage|tutorial", "getting started|quick start|guide", "api|interface|public"],
    "debugging": ["error|bug|issue|problem|fix|debug", "why.*not|what.*wrong|troubleshoot"],
}
#: Names of symbols (camelCase or PascalCase, snake_case), of calls, and extensions of source files.
SYMBOL, CALL, SOURCES = "^(?:[a-z][a-zA-Z0-9_]*[A-Z][a-zA-Z0-9_]*|[A-Z][a-zA-Z0-9_]*|[a-z][a-z0-9_]*_[a-z0-9_]*)$", "^[a-z][a-z0-9_]*$", "py|js|ts|java|cpp|c|h|go|rs|rb|php"
#: A character of words, and white space, as the patterns of texts mean them.
WORD, SPACE = r"\p{L}\p{N}_", r"\t-\r\x1c-\x20\x85\p{Z}"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(TOKEN), F.lit(0))


def sanitize_query(text: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " "))


def lines(text: Column) -> Column:
    """Lines without a trailing empty one."""
    x = F.split(text, "\n")
    return F.when((F.size(x) > 1) & (F.element_at(x, -1) == ""), F.slice(x, 1, F.size(x) - 1)).otherwise(x)


def tokens_div4(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def tokens_generic(text: Column) -> Column:
    """Code characters / 2.5 + other characters / 4.2 + white space / 1.5, at least 1 unless empty."""
    code = F.regexp_count(text, F.lit(r"[{}()\[\];,.:=+\-*/]")).cast("double")
    space = F.regexp_count(text, F.lit(f"[{SPACE}]")).cast("double")
    other = F.length(text) - code - space
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(code / 2.5 + other / 4.2 + space / 1.5).cast("long")))


def truncate_to(text: Column, budget: int, keep_end: bool = False) -> Column:
    """The longest prefix (or suffix) within the budget under length div 4, and a marker where something went."""
    n = F.lit(4 * budget + 3)
    cut = F.concat(F.lit("...[truncated]\n"), F.right(text, n)) if keep_end else F.concat(F.left(text, n), F.lit("\n[truncated]..."))
    return F.when(tokens_div4(text) <= budget, text).otherwise(cut)


def intent(text: Column) -> Column:
    """The first of INTENTS with a pattern that the text holds, else general."""
    q, out = F.lower(text), None
    for name, patterns in INTENTS.items():
        hit = q.rlike("(?d)(?:^|[^" + WORD + "])(?:" + "|".join(patterns) + ")(?:$|[^" + WORD + "])")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def complexity(text: Column, symbols: Column) -> Column:
    """low, medium or high by the words and the symbols of a query."""
    n = F.regexp_count(text, F.lit(f"[^{SPACE}]+"))
    return F.when((n > 20) | (F.size(symbols) > 4), "high").when((n > 10) | (F.size(symbols) > 2), "medium").otherwise("low")


def query_symbols(text: Column) -> Column:
    """Names that look like symbols or calls, sorted."""
    words = F.filter(F.regexp_extract_all(text, F.lit(f"[{WORD}]+"), F.lit(0)), lambda x: x.rlike(SYMBOL))
    calls = F.filter(F.regexp_extract_all(text, F.lit(rf"([{WORD}]+)\(\)"), F.lit(1)), lambda x: x.rlike(CALL))
    return F.array_sort(F.array_distinct(F.concat(words, calls)))


def query_files(text: Column) -> Column:
    """Words with an extension, and the extensions alone of paths to source files, sorted."""
    paths = F.regexp_extract_all(text, F.lit(f"[{WORD}][{WORD}/.\\-]*"), F.lit(0))
    ends = F.filter(F.transform(paths, lambda x: F.regexp_extract(x, rf"^.+\.({SOURCES})(?:$|[^{WORD}])", 1)), lambda x: x != "")
    names = F.regexp_extract_all(text, F.lit(rf"[{WORD}][{WORD}.\-]*\.[{WORD}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(ends, names)))


def is_external(link: Column) -> Column:
    return link.contains("://") | link.startswith("mailto:") | link.startswith("tel:")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def markdown_links(text: Column) -> Column:
    """Targets of internal links, neither external nor anchors."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)), lambda t: ~(is_external(t) | t.startswith("#")))


def strip_blocks(text: Column, tag: str = "think") -> Column:
    return F.ltrim(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>\s*", ""))


def list_and_more(items: Column, n: Column, most: int = 10) -> Column:
    """A list of the first items, and how many of the n there are beside them."""
    shown = F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(shown, F.when(n > most, F.concat(F.lit("\n- ... and "), (n - most).cast("string"), F.lit(" more"))).otherwise(""))


def header(parts: Sequence[Column]) -> Column:
    return F.concat_ws(" | ", *parts)
