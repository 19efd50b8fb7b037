"""Pages of a documentation: index of all pages, navigation, links in answers, templates, explorer, generation."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections of the index in their order, with the paths of their pages.
SECTIONS = {"Overview": "^index[.]md$", "Guides": "^guides/[^/]+[.]md$", "Modules": "^modules/(?:.*/)?index[.]md$", "API Reference": "^api/index[.]md$", "Files": "^api/.*[.]md$"}


def section(page: Column) -> Column:
    """The first of SECTIONS that a page's path belongs to, null for other pages."""
    out = None
    for name, pattern in SECTIONS.items():
        out = F.when(page.rlike(pattern), name) if out is None else out.when(page.rlike(pattern), name)
    return out.when(F.lit(False), "")


def title(text: Column, page: Column) -> Column:
    """The first heading of a page, or its name."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# +(.+)$", 1)), F.lit("")), F.regexp_extract(page, r"([^/]+?)(?:\.md)?$", 1))


def ordered(pages: DataFrame) -> DataFrame:
    """pages (page, text) of a section, with section, title and their place in the index."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(SECTIONS) for x in (k, i)))
    p = pages.withColumn("section", section(F.col("page"))).where("section is not null")
    return p.select("page", "text", "section", title(F.col("text"), F.col("page")).alias("title"), order[F.col("section")].alias("place"))


def index_lines(pages: DataFrame, name: str, about: str = "") -> DataFrame:
    """place, page, line of the index: heading, then each section with a link to each of its pages. Sort by place and page."""
    spark = pages.sparkSession
    p = ordered(pages)
    heads = p.select("section", "place").distinct().select("place", F.lit("").alias("page"), F.concat(F.lit("\n## "), "section", F.lit("\n")).alias("line"))
    links = p.select("place", "page", F.concat(F.lit("- ["), "title", F.lit("]("), "page", F.lit(")")).alias("line"))
    top = spark.createDataFrame([(-1, "", f"# {name}\n" + (f"\n> {about}\n" if about else ""))], "place int, page string, line string")
    return top.unionByName(heads).unionByName(links)


def full_text(pages: DataFrame) -> DataFrame:
    """place, page, text of every page behind a mark with its path, in the index's order (a row a page: no text of all)."""
    return ordered(pages).select("place", "page", F.concat(F.lit("\n---\n\n<!-- "), "page", F.lit(" -->\n\n"), "text").alias("text"))


def navigation(pages: DataFrame) -> DataFrame:
    """section, title, page of the menu: home, guides, modules (by their names) and the index of the pages, with their rank."""
    words = lambda x, sep: F.initcap(F.replace(x, F.lit(sep), F.lit(" ")))
    guide, module = F.regexp_extract("page", r"^guides/([^/]+)[.]md$", 1), F.regexp_extract("page", r"^modules/([^/]+)/index[.]md$", 1)
    found = pages.select("page", guide.alias("g"), module.alias("m")).select("page", F.when(F.col("g") != "", F.struct(F.lit(1).alias("place"), F.lit("Guides").alias("section"), words(F.col("g"), "-").alias("title"))).when(F.col("m") != "", F.struct(F.lit(2).alias("place"), F.lit("Modules").alias("section"), words(F.col("m"), "_").alias("title"))).when(F.col("page") == "api/index.md", F.struct(F.lit(3).alias("place"), F.lit("API Reference").alias("section"), F.lit("API Reference").alias("title"))).alias("x"))
    home = pages.sparkSession.createDataFrame([("index.md", 0, "Home", "Home")], "page string, place int, section string, title string")
    out = home.unionByName(found.where("x is not null").select("page", "x.place", "x.section", "x.title"))
    return out.select("place", "section", "title", "page").orderBy("place", "page")


def linked(answer: Column, names: Column, urls: Column) -> Column:
    """answer with a Markdown link at each name of a file (with lines, if it has them) that is one of names; urls go with them."""
    ref = r"[\w\-/]+\.py(?::\d+(?:-\d+)?)?"
    found = F.regexp_extract_all(answer, F.lit(ref), F.lit(0))
    between = F.split(answer, ref)

    def link(x: Column) -> Column:
        file = F.regexp_extract(x, r"^([^:]+)", 1)
        at = F.array_position(F.transform(names, lambda n: (n == file) | n.endswith(F.concat(F.lit("/"), file))), True)
        return F.when(at > 0, F.concat(F.lit("["), x, F.lit("]("), F.get(urls, (at - 1).cast("int")), F.lit(")"))).otherwise(x)

    return F.array_join(F.zip_with(between, F.concat(F.transform(found, link), F.array(F.lit(""))), lambda b, l: F.concat(b, l)), "")


TEMPLATES: dict[str, str] = {"document_code": "Document this $language file.\n\n$code", "answer_question": "Question: $question\n\nContext:\n$context", "explain_code": "Explain this $language code.\n\n$code"}


def add_template(name: str, template: str) -> None:
    """Add a template ($name for what is put in), or put it in the place of another."""
    TEMPLATES[name] = template


def render(name: str, **values: Column) -> Column:
    """A template with columns put in; an unknown template or one that lacks a value raises ValueError."""
    if name not in TEMPLATES:
        raise ValueError(f"no template {name!r}; there are {sorted(TEMPLATES)}")
    parts = []
    for literal, key in pieces(TEMPLATES[name]):
        if key is not None and key not in values:
            raise ValueError(f"template {name!r} needs {key!r}")
        parts.append(F.lit(literal) if key is None else F.coalesce(values[key].cast("string"), F.lit("")))
    return F.concat(*parts)


def pieces(template: str) -> Iterator[tuple[str, str | None]]:
    """(text, None) and ('', name) for the texts and the placeholders of a template; $$ stands for $."""
    at = 0
    for m in string.Template.pattern.finditer(template):
        yield template[at : m.start()], None
        key = m.group("named") or m.group("braced")
        yield ("", key) if key else ("$", None)
        at = m.end()
    yield template[at:], None


def generate(plan: DataFrame, prompts: DataFrame, write: Callable[[str], str]) -> DataFrame:
    """page, text: what a writer makes of each planned page's prompt (page, prompt), in batches on the executors; a page whose
    writer fails has the error as its text and failed = true."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, prompt in zip(pdf.page, pdf.prompt, strict=True):
                try:
                    rows.append((page, write(prompt), False))
                except Exception as e:  # noqa: BLE001  one page's failure is told, not spread
                    rows.append((page, str(e), True))
            yield pd.DataFrame(rows, columns=["page", "text", "failed"])

    return plan.join(prompts, "page").select("page", "prompt").mapInPandas(run, "page string, text string, failed boolean")


def explorer(files: DataFrame, category: Column, most: int = 5) -> DataFrame:
    """place, html: totals and, for each category, its number of files and the first few; sort by place."""
    c = files.withColumn("category", category)
    w = Window.partitionBy("category").orderBy("file_id")
    shown = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("category").agg(F.array_sort(F.collect_list("file_id")).alias("a"))
    g = c.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(shown, "category")
    item = lambda x: F.concat(F.lit("<li>"), F.regexp_extract(x, "([^/]+)$", 1), F.lit("</li>"))
    more = F.when(F.col("n") > most, F.concat(F.lit("<li><em>... and "), (F.col("n") - most).cast("string"), F.lit(" more files</em></li>"))).otherwise("")
    parts = g.select(F.col("category").alias("place"), F.concat(F.lit("<h3>"), F.initcap("category"), F.lit("</h3><p>Files: "), F.col("n").cast("string"), F.lit("</p><ul>"), F.array_join(F.transform("a", item), ""), more, F.lit("</ul>")).alias("html"))
    whole = files.agg(F.count(F.lit(1)).alias("n"), F.sum("line_count").alias("l"), F.count_distinct("language").alias("k"))
    return whole.select(F.lit("").alias("place"), F.concat(F.lit("<h2>Repository Statistics</h2><p>Total Files: "), F.col("n").cast("string"), F.lit("</p><p>Total Lines: "), F.coalesce("l", F.lit(0)).cast("string"), F.lit("</p><p>Languages: "), F.col("k").cast("string"), F.lit("</p>")).alias("html")).unionByName(parts)
