"""One object for what a user or a tool asks of an index: lookups, references, impact, search, context, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .functions import text
from .operators import context, fusion, graph, lexical
from .sources.ingest import ingest, ingest_directory
from .sources.store import TABLES, Store


#: Tables with a lexical index: what a hit is named by, and the text.
INDEXED = {"chunks": ("chunk_id", "content"), "symbols": ("symbol_id", "name")}


class Engine:
    """Over the tables of a store. Questions are texts or a table (query_id, text); answers are DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def ingest(self, sources: DataFrame | str, **options) -> None:
        """A table of sources (file_id, language, text), or a directory."""
        if isinstance(sources, str):
            ingest_directory(self.spark, sources, self.store, **options)
        else:
            ingest(sources, self.store, **options)
        self.index()

    def index(self) -> None:
        """Build the lexical indexes of the tables as they are now; those of earlier versions go."""
        for table, (key, column) in INDEXED.items():
            home, name = f"{self.store.root}/_lexical", f"{table}-{self.store.version(table)}-{lexical.FORMAT}"
            lexical.Index(self.spark, f"{home}/{name}").build(self.table(table), key, column, places=table == "chunks")
            for other in self.store._names(home):
                if other.startswith(f"{table}-") and other != name:
                    at, fs = self.store._fs(f"{home}/{other}")
                    fs.delete(at, True)

    def _indexed(self, table: str) -> lexical.Index | None:
        """The index of a table, if there is one of its current version (and of the format of this code)."""
        home, name = f"{self.store.root}/_lexical", f"{table}-{self.store.version(table)}-{lexical.FORMAT}"
        return lexical.Index(self.spark, f"{home}/{name}") if name in self.store._names(home) else None

    def table(self, name: str) -> DataFrame:
        return self.store.load(name)

    def register_views(self, prefix: str = "") -> list[str]:
        """Temporary views of all tables, for the user's own SQL."""
        have = [t for t in TABLES if self.store.exists(t)]
        for t in have:
            self.table(t).createOrReplaceTempView(prefix + t)
        return [prefix + t for t in have]

    def register_functions(self, prefix: str = "") -> list[str]:
        """Views of all tables and functions over them (tessera.sql), for the user's own SQL; gives the names of the functions."""
        self.register_views(prefix)
        return sql.register(self.spark, prefix=prefix)

    def files(self, language: str | None = None) -> DataFrame:
        f = self.table("files")
        return f if language is None else f.where(F.col("language") == language)

    def lookup_symbol(self, name: str) -> DataFrame:
        return self.table("symbols").where(F.col("name") == name)

    def file_summary(self, file_id: str) -> DataFrame:
        """The file's row with its numbers of symbols, of files that it imports and of files that import it."""
        n = lambda table, column, name: self.table(table).where(F.col(column) == file_id).agg(F.count(F.lit(1)).alias(name))
        out = self.table("files").where(F.col("file_id") == file_id)
        for one in (n("symbols", "file_id", "n_symbols"), n("edges", "src", "n_out"), n("edges", "dst", "n_in")):
            out = out.join(F.broadcast(one))  # one row
        return out

    def who_references(self, name: str) -> DataFrame:
        """symbol, file: the files that import a file which defines the name."""
        s = self.lookup_symbol(name).select(F.col("symbol_id").alias("symbol"), F.col("file_id").alias("dst"))
        return s.join(self.table("edges"), "dst").select("symbol", F.col("src").alias("file")).distinct()

    def impact(self, changed: DataFrame) -> DataFrame:
        """file, hit: what depends on the changed files (file) directly or through one other."""
        return graph.dependents_within_two(changed, self.table("edges"))

    def retrieve(self, questions: DataFrame | str, n: int = 10, language: str | None = None, file_id: str | None = None, **_unused) -> DataFrame:
        """query_id, id, score, rank: BM25 over the chunks, of one language or file; other filters are ignored. Without a filter
        from the index, where it is current; else by a scan."""
        index = self._indexed("chunks") if language is None and file_id is None else None
        if index:
            return index.search(self._asked(questions), n)
        c = self.table("chunks")
        for column, value in (("language", language), ("file_id", file_id)):
            c = c if value is None else c.where(F.col(column) == value)
        return lexical.search(c, self._asked(questions), "chunk_id", "content", n)

    def symbols(self, questions: DataFrame | str, n: int = 25) -> DataFrame:
        """query_id, id, score, rank: BM25 over the names of symbols, from the index, where it is current."""
        index = self._indexed("symbols")
        if index:
            return index.search(self._asked(questions), n, every=False)
        return lexical.search(self.table("symbols"), self._asked(questions), "symbol_id", "name", n, every=False)

    def phrases(self, questions: DataFrame | str, n: int = 10) -> DataFrame:
        """query_id, id, score, rank of the chunks that hold a question's words next to one another."""
        index = self._indexed("chunks")
        if not index:
            self.index()
        return (index or self._indexed("chunks")).phrases(self._asked(questions), n)

    def search(self, questions: DataFrame | str, n: int = 10, near: DataFrame | None = None) -> DataFrame:
        """query_id, id, source, rank: chunks, then symbols; fused by reciprocal ranks with a list of nearest chunks (query_id,
        id, rank) where there is one."""
        q = self._asked(questions)
        return fusion.hybrid(near, self.retrieve(q, n), self.symbols(q), n)

    def context(self, questions: DataFrame | str, budget: int = 2000) -> DataFrame:
        """The rows of a context for each question within the budget, by the question's intent."""
        f, q, index = self.table("files").select("*", F.col("file_id").alias("doc_id")), self._asked(questions), self._indexed("chunks")
        best = index.search(q, 20, every=False) if index else None
        return context.answer_context(q, f, self.table("chunks"), self.table("symbols"), self.table("edges"), budget, best=best)

    def analyze(self, questions: DataFrame | str) -> DataFrame:
        """query_id, intent, complexity, symbols, files of each question."""
        q, names = self._asked(questions), text.query_symbols(F.col("text"))
        return q.select("query_id", text.intent(F.col("text")).alias("intent"), text.complexity(F.col("text"), names).alias("complexity"), names.alias("symbols"), text.query_files(F.col("text")).alias("files"))

    def _asked(self, questions: DataFrame | str) -> DataFrame:
        return questions if isinstance(questions, DataFrame) else self.spark.createDataFrame([("0", questions)], "query_id string, text string")
