"""Inverted index and BM25."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, TOKEN, tokens
from .sizes import small_side

K1, B, FLOOR = 1.2, 0.75, 1e-6


def postings(rows: DataFrame, id_col: str, text_col: str, positions: bool = False) -> DataFrame:
    """id, dl, term, tf (and pos where asked for): a row for each distinct term of a row, counted inside it; nothing is shuffled
    but ids, to find those that repeat. Rows of one of those are put together by a shuffle."""
    t = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if positions:
        t = t.select("id", tokens(F.col("text")).alias("t"))
        return t.select("id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
    again = small_side(t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_id")))
    same, kind = F.col("id").eqNullSafe(F.col("_id")), t.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):  # texts can be long
                ids, words = b.column(0).slice(i, 1000), b.column(1).slice(i, 1000)
                encoded = pc.list_flatten(words).dictionary_encode()
                size = max(1, len(encoded.dictionary))
                key, tf = np.unique(pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64) * size + encoded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                of, dl = pa.array(key // size), pc.list_value_length(words).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(of), dl.take(of), encoded.dictionary.take(pa.array(key % size)), pa.array(tf)], ["id", "dl", "term", "tf"])

    alone = t.join(again, same, "left_anti").select("id", tokens(F.col("text")).alias("t")).mapInArrow(count, f"id {kind}, dl long, term string, tf long")
    more = t.join(again, same, "left_semi").select("id", tokens(F.col("text")).alias("t"))
    more = more.select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return alone.unionByName(more)


def bm25(rows: DataFrame, query: str, id_col: str, text_col: str, n: int = 50, where=None) -> DataFrame:
    """id, score of the rows with all terms, best first; statistics cover all rows, `where` filters afterwards.

    Terms are counted inside each row, so only rows with a term leave the scan; document frequencies and lengths are one
    aggregate over it.
    """
    terms = list(dict.fromkeys(tokens_of(query)))
    if not terms:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    keep = F.lit(True) if where is None else where
    d = rows.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"), keep.alias("keep"))
    d = d.select("id", "keep", F.size("t").alias("dl"), *(F.size(F.filter("t", equals(x))).cast("double").alias(f"tf{i}") for i, x in enumerate(terms)))
    s = d.agg(F.count(F.lit(1)).cast("double").alias("N"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"n{i}") for i in range(len(terms))))
    hit = d.where("keep")
    for i in range(len(terms)):
        hit = hit.where(F.col(f"tf{i}") > 0)
    hit = hit.join(F.broadcast(s))  # one row
    parts = []
    for i in range(len(terms)):
        idf = F.greatest(F.ln((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(FLOOR))
        tf = F.col(f"tf{i}")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return hit.select("id", F.round(sum(parts[1:], parts[0]), 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def search(rows: DataFrame, queries: DataFrame, id_col: str, text_col: str, n: int = 50, every: bool = True) -> DataFrame:
    """query_id, id, score, rank: BM25 for a table of queries (query_id, text); rows with all terms, or with any.

    Only the postings of the queries' terms leave the scan: the terms are joined to the words of a row inside its task.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    t = rows.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).select("id", "t", F.size("t").cast("long").alias("dl"))
    size = F.regexp_count(F.translate(F.lower(F.col(text_col)), ACCENTED, PLAIN), F.lit(TOKEN))  # counts, where the terms are not needed
    whole = rows.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg(size).alias("avgdl"))
    p = t.select("id", "dl", F.explode("t").alias("term")).join(small_side(q.select("term").distinct()), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    return ranked(p, whole, q, n, every)


def ranked(p: DataFrame, whole: DataFrame, q: DataFrame, n: int, every: bool) -> DataFrame:
    """The best n rows a query. p: id, dl, term, tf; whole: n_rows, avgdl; q: query_id, term."""
    df = p.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("held"))
    d = p.join(df, "term").join(F.broadcast(whole))  # one row
    idf = F.greatest(F.ln((F.col("n_rows") - F.col("held") + 0.5) / (F.col("held") + 0.5)), F.lit(FLOOR))
    d = d.select("term", "id", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("part"))
    hit = d.join(small_side(q), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("have"))
    if every:
        hit = hit.join(small_side(q.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))), "query_id").where("have = terms")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hit.select("query_id", "id", "score", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= n)


#: Files of an index are dealt to BUCKETS by term; a part of a score is one of LEVELS; a segment has about SEGMENT rows.
BUCKETS, LEVELS, SEGMENT = 16, 64, 16384
#: Of the stored tables; an engine names its indexes by it, so that those of another format are built anew.
FORMAT = 2
#: Terms of queries that an index of their words only may send to all tasks; above it all terms are indexed.
TERMS = 100_000
#: Scores are rounded to six places, so a bound may be short of a score by so much.
SLACK = 2e-6
#: Postings of a search up to which they are all looked at: a threshold is worth its pass where lists are longer.
SHORT = 200_000
#: Queries of a search up to which blocks are pruned by a threshold; more are scored segment by segment, so many (query, term)
#: at a time.
FEW, PAIRS = 64, 500_000
#: In a search of many queries for any word: words of queries in a row, how many times more segments each pass has seen than the
#: one before, and scores that are held at a time.
WORDS, GROWTH, SCORES = 100_000, 4, 4_000_000


class Index:
    """Postings in blocks ordered by impact, as a table below a folder; built once, searched with block-max pruning.

    A block holds the postings of one term, one level of impact and one segment of the rows (by a hash of the id), so that no
    term is too frequent for one task and the blocks of different terms over the same rows have the same segment. Inside a
    segment rows are numbered in the order of their ids, which are kept once. A block tells the largest impact (what a posting
    adds to a score, before the term's weight) and the number of postings; a search for few queries reads those columns of its
    terms first. A row's score is at most a block's impact and, for the query's other terms, their largest impacts in that
    segment. The best blocks are scored in full, the n-th best score is the query's threshold, and only blocks with a bound that
    reaches it are read. A table of many queries meets each segment once: the task of a segment scores all of them on it and
    gives its n best rows of each, so no list of candidates is shuffled. Results are exact both ways.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._table = spark, root.rstrip("/"), None

    def build(self, rows: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None, places: bool = False) -> Index:
        """Write the index of all terms, or of those of the queries `only` (query_id, text). Statistics cover all rows. The texts
        are read once; what is shuffled are the counts of each row. places: also where in a row each term is, for phrases."""
        kind = rows.schema[id_col].dataType.simpleString()
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "1000")  # for these writes; texts can be long
        try:
            counts = self._counted(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), only, places)
            segs = F.ceil(F.col("n_rows") / SEGMENT).cast("long")
            whole = counts.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("dl").alias("avgdl"))
            whole.withColumn("segs", segs).withColumn("id_type", F.lit(kind)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/whole")
            w, self._table = self._whole().first(), None
            n_segs = max(1, w.segs)
            d = counts.withColumn("seg", F.pmod(F.xxhash64("id"), F.lit(n_segs))).repartition(n_segs, "seg").sortWithinPartitions("seg")
            d = d.mapInArrow(lambda batches: segments(batches, w.avgdl, places), block_schema(kind))
            bucket = F.when(F.col("term").isNull(), -1).otherwise(bucket_of("term") + F.when(F.col("level") < 0, F.lit(BUCKETS)).otherwise(0))
            d = d.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "level", "seg")
            d.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/blocks")
        finally:
            self.spark.conf.set(key, before)
        return self

    def _whole(self) -> DataFrame:
        return self.spark.read.schema("n_rows double, avgdl double, segs long, id_type string").parquet(f"{self.root}/whole")

    def _stored(self) -> DataFrame:
        """Blocks of postings (bucket from 0 on), where terms are (level -1, bucket from BUCKETS on), ids of a segment (bucket -1)."""
        if self._table is None:  # its files are listed once
            self._table = self.spark.read.schema(block_schema(self._whole().first().id_type) + ", bucket int").parquet(f"{self.root}/blocks")
        return self._table

    def _blocks(self) -> DataFrame:
        return self._stored().where(F.col("bucket").between(0, BUCKETS - 1))

    def _counted(self, rows: DataFrame, only: DataFrame | None, places: bool) -> DataFrame:
        """id, dl, terms, tfs, at (places, those of one term behind the other): the different terms of each row, written once."""
        terms = None
        d = rows.select("id", tokens(F.col("text")).alias("t"))
        if only is not None:
            got = [r.term for r in asked(only).select("term").distinct().limit(TERMS + 1).collect()]
            terms = pa.array(got, pa.string()) if len(got) <= TERMS else None

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, t = b.column(0), b.column(1)
                dl = pc.list_value_length(t).cast(pa.int64())
                flat = pc.list_flatten(t)
                if terms is None:
                    encoded = flat.dictionary_encode()
                    code, words = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
                else:
                    code, words = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False), terms
                row = pc.list_parent_indices(t).to_numpy(zero_copy_only=False).astype(np.int64)
                both = row[code >= 0] * max(1, len(words)) + code[code >= 0]
                key, tf = np.unique(both, return_counts=True)
                size = np.bincount(key // max(1, len(words)), minlength=len(b))
                begin = np.append(0, np.cumsum(size)).astype(np.int32)
                each = words.take(pa.array(key % max(1, len(words))))
                at = pa.nulls(len(b), pa.list_(pa.int32()))
                if places:
                    first = np.cumsum(dl.fill_null(0).to_numpy()) - dl.fill_null(0).to_numpy()
                    place = (np.arange(len(row)) - first[row])[code >= 0][np.argsort(both, kind="stable")]
                    many = np.append(0, np.cumsum(np.bincount(row[code >= 0], minlength=len(b)))).astype(np.int32)
                    at = pa.ListArray.from_arrays(pa.array(many), pa.array(place.astype(np.int32)))
                lists = [pa.ListArray.from_arrays(pa.array(begin), x) for x in (each, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([ids, dl, *lists, at], ["id", "dl", "terms", "tfs", "at"])

        schema = f"id {rows.schema['id'].dataType.simpleString()}, dl long, terms array<string>, tfs array<int>, at array<int>"
        d.mapInArrow(count, schema).write.mode("overwrite").parquet(f"{self.root}/counts")
        return self.spark.read.schema(schema).parquet(f"{self.root}/counts")

    def search(self, queries: DataFrame, n: int = 50, every: bool = True) -> DataFrame:
        """query_id, id, score, rank of the n best rows a query (query_id, text): those with all its terms, or with any."""
        if self._many(queries) and not every:
            hits = self._in_passes(self._planned(queries, False), n)
        elif self._many(queries):
            q = self._planned(queries, False)
            hits = self._meeting(q, self._blocks(), "score double")(q, scorer(n, every))
            hits = hits.select("query_id", "id", F.round("score", 6).alias("score"))
        else:
            q, blocks = self._narrowed(queries, n, every)
            ids = self._stored().where("bucket = -1 and dls is null").select("seg", F.posexplode("ids").alias("row", "id"))
            hits = self._scored(self._rows_of(blocks), q, every).join(ids, ["seg", "row"])
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return hits.select("query_id", "id", "score", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= n)

    def reads(self, queries: DataFrame, n: int = 50, every: bool = True) -> DataFrame:
        """query_id, held, kept: postings that the query's terms have, and those of them that candidates are taken from (all,
        where there are many queries)."""
        if self._many(queries):
            held = self._planned(queries, every).groupBy("query_id").agg(F.sum("df").alias("held"))
            return held.withColumn("kept", F.col("held"))
        q, blocks = self._narrowed(queries, n, every)
        held, kept = q.groupBy("query_id").agg(F.sum("df").alias("held")), blocks.groupBy("query_id").agg(F.sum("n").alias("kept"))
        return held.join(kept, "query_id", "left").select("query_id", "held", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))

    @staticmethod
    def _many(queries: DataFrame) -> bool:
        return queries.limit(FEW + 1).count() > FEW

    def _meeting(self, q: DataFrame, blocks: DataFrame, added: str) -> Callable[[DataFrame, Callable], DataFrame]:
        """meet(queries, work): what work(segment's blocks and ids, queries) gives for each segment and each part of the queries:
        query_id, id and the added columns. Both are dealt to tasks by Spark; blocks are read once for each part. q (query_id, bucket,
        term, ...): all queries that meet; where several meetings are in one plan, Spark deals the blocks once for all."""
        segs, shards = max(1, self._whole().first().segs), max(1, -(-q.count() // PAIRS))
        columns = ["seg", "term", "rows", "parts", "at", "ids", "dls"]
        mine = blocks.select((F.col("bucket") % BUCKETS).alias("bucket"), *columns)
        mine = mine.join(small_side(q.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").drop("bucket")
        mine = mine.unionByName(self._stored().where("bucket = -1").select(columns))
        mine = mine.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {self._whole().first().id_type}, {added}"

        def meet(q: DataFrame, work) -> DataFrame:
            theirs = q.where("query_id is not null").drop("bucket").withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int"))
            theirs = theirs.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(segs - 1)))).withColumn("seg", F.col("seg").cast("long"))
            return mine.groupBy("seg", "shard").cogroup(theirs.groupBy("seg", "shard")).applyInArrow(lambda a, b: work(a, b), schema)

        return meet

    def _in_passes(self, q: DataFrame, n: int) -> DataFrame:
        """query_id, id, score of rows with any term of each query, its n best among them. q: as _planned() gives.

        A segment is dealt to one row of a table once, and queries to rows of some WORDS words; both are read where they meet,
        and neither is shuffled for it. A pass takes GROWTH - 1 times the segments before it, and gives only rows that
        reach the n-th best score of those, so that its rows follow the number of queries, not that of segments.
        """
        whole = self._whole().first()
        segs, shards = max(1, whole.segs), max(1, -(-q.count() // min(PAIRS, WORDS)))
        columns = ["seg", "term", "rows", "parts", "ids"]
        mine = self._blocks().join(small_side(q.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").select(columns)
        mine = mine.unionByName(self._stored().where("bucket = -1 and dls is null").select(columns)).repartition(segs, "seg")
        schema = f"seg long, terms array<string>, ends array<int>, rows array<int>, parts array<double>, ids array<{whole.id_type}>"
        segments = self._written(mine.groupBy("seg").applyInArrow(packed, schema), "segments")
        words = q.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("words"))
        words = self._written(words.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards))), "words")
        best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {whole.id_type}, score double"
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before, done, found, least = self.spark.conf.get(key), 0, None, F.lit(None).cast("double")
        while done < segs:
            upto, ask = min(segs, max(1, GROWTH * done)), words
            if found is not None:
                ask = words.join(found.where(F.col("rank") == n).select("query_id", (F.col("score") - SLACK).alias("least")), "query_id", "left")
                least = F.col("least")
            ask = ask.repartition(shards, "shard").groupBy("shard").agg(F.collect_list(F.struct("query_id", "words", least.alias("least"))).alias("asks"))
            ask = self._written(ask, "asks").select("asks").hint("shuffle_replicate_nl")
            self.spark.conf.set(key, "1")  # for this write; a row holds a segment
            try:
                hits = self._written(segments.where(F.col("seg").between(done, upto - 1)).crossJoin(ask).mapInArrow(passer(n), schema), "hits")
            finally:
                self.spark.conf.set(key, before)
            hits = hits if found is None else hits.unionByName(found.drop("rank"))
            if upto < segs:
                found = self._written(hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= n), "found")
            done = upto
        return hits

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """A small table of a search, that several of its steps read; these go when the index is built anew or cleaned."""
        path = f"{self.root}/searches/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _planned(self, queries: DataFrame, every: bool) -> DataFrame:
        """query_id, term, bucket, df, idf, terms (of the query), drives: does the search take candidates from this term."""
        q = small_side(self._written(asked(queries).withColumn("bucket", bucket_of("term")), "terms"))
        terms = q.select("bucket", "term")
        df = self._blocks().select("bucket", "term", "n").join(terms, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        mine = Window.partitionBy("query_id")
        q = q.withColumn("terms", F.count(F.lit(1)).over(mine)).join(df, ["bucket", "term"])
        q = q.join(F.broadcast(self._whole().select("n_rows")))  # one row
        q = q.withColumn("idf", F.greatest(F.ln((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR)))
        if every:
            q = q.withColumn("met", F.count(F.lit(1)).over(mine)).where("met = terms")
        first = F.row_number().over(mine.orderBy("df", "term")) == 1 if every else F.lit(True)
        return small_side(self._written(q.select("query_id", "term", "bucket", "df", "idf", "terms", first.alias("drives")), "planned"))

    def _bounds(self, q: DataFrame, every: bool) -> DataFrame:
        """query_id, bucket, term, level, seg, n, bound of the blocks that candidates may come from.

        With all terms, candidates come from the rarest one, and the bound has the tops of the others. With any, a row is taken
        from the one of its terms with the largest top in the segment, so that the bound has the smaller tops only.
        """
        key = ["query_id", "term", "seg"]
        b = self._blocks().select("bucket", "term", "level", "seg", "n", "hi").join(q, ["bucket", "term"])
        tops = b.groupBy(*key, "terms").agg(F.max(F.col("hi") * F.col("idf")).alias("top"))
        of_seg = Window.partitionBy("query_id", "seg")
        if every:
            tops = tops.withColumn("met", F.count(F.lit(1)).over(of_seg)).where("met = terms").withColumn("others", F.sum("top").over(of_seg) - F.col("top"))
        else:
            lower = of_seg.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, -1)
            tops = tops.withColumn("others", F.coalesce(F.sum("top").over(lower), F.lit(0.0)))
        out = b.where("drives").join(tops.select(*key, "others"), key)
        return out.select("query_id", "bucket", "term", "level", "seg", "n", (F.col("hi") * F.col("idf") + F.col("others")).alias("bound"))

    def _narrowed(self, queries: DataFrame, n: int, every: bool) -> tuple[DataFrame, DataFrame]:
        """_planned(), and the blocks of _bounds() that reach their query's threshold."""
        q = self._planned(queries, every)
        bounds = self._written(self._bounds(q, every), "bounds")
        if (bounds.agg(F.sum("n")).first()[0] or 0) <= SHORT:
            return q, bounds
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "level", "seg")
        seeds = bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n)
        before = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = seeds.withColumn("before", before).where(F.col("before") < 4 * n)
        first = self._scored(self._rows_of(seeds), q, every)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seg", "row")
        least = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).where(F.col("r") == n).select("query_id", (F.col("score") - SLACK).alias("least"))
        kept = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least")
        return q, self._written(kept, "kept")

    def _rows_of(self, blocks: DataFrame) -> DataFrame:
        """query_id, seg, row of the rows in blocks."""
        key = ["bucket", "term", "level", "seg"]
        got = self._blocks().select(*key, "rows").join(small_side(blocks.select("query_id", *key)), key)
        return got.select("query_id", "seg", F.explode("rows").alias("row")).distinct()

    def _scored(self, rows: DataFrame, q: DataFrame, every: bool) -> DataFrame:
        """query_id, seg, row, score of rows (query_id, seg, row): the parts that they have of their queries' terms, looked up."""
        probes = rows.join(q.select("query_id", "bucket", "term", "idf", "terms"), "query_id")
        posts = self._blocks().select("bucket", "term", "seg", "rows", "parts").join(q.select("bucket", "term"), ["bucket", "term"], "left_semi")
        posts = posts.select("term", "seg", F.explode(F.arrays_zip("rows", "parts")).alias("p")).select("term", "seg", F.col("p.rows").alias("row"), F.col("p.parts").alias("part"))
        got = probes.join(posts, ["term", "seg", "row"]).groupBy("query_id", "seg", "row", "terms")
        got = got.agg(F.round(F.sum(F.col("idf") * F.col("part")), 6).alias("score"), F.count(F.lit(1)).alias("have"))
        return (got.where("have = terms") if every else got).select("query_id", "seg", "row", "score")

    def phrases(self, queries: DataFrame, n: int = 50) -> DataFrame:
        """query_id, id, score, rank of the n best rows that hold the words of a query (query_id, text) next to one another; a
        phrase counts as one term. From an index built with places.

        The task of a segment joins the places of a phrase's words, less their offsets, the rarest first. Segments are met
        twice, over one shuffle of their blocks: the rows that hold a phrase are counted first, since its weight is in the
        scores that the n best are taken by. The texts are not read.
        """
        words = queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("offset", "term")).withColumn("bucket", bucket_of("term"))
        q = self._written(words.withColumn("words", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "words")
        at = self._stored().where(F.col("bucket") >= BUCKETS)
        meet = self._meeting(q, at, "part double")
        k = meet(q, phraser(0, None)).groupBy("query_id").agg(F.sum("part").alias("k"))
        whole = self._whole().first()
        idf = F.greatest(F.ln((F.lit(whole.n_rows) - F.col("k") + 0.5) / (F.col("k") + 0.5)), F.lit(FLOOR))
        hits = meet(q.join(k, "query_id").withColumn("idf", idf).drop("k"), phraser(n, whole.avgdl)).select("query_id", "id", F.round("part", 6).alias("score"))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
        return hits.withColumn("rank", best).where(F.col("rank") <= n)

    def clean(self) -> None:
        """Delete the small tables of searches (no result of one may still be unread)."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/searches")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def block_schema(kind: str) -> str:
    return f"term string, level int, seg long, hi double, n long, rows array<int>, parts array<double>, at array<int>, ids array<{kind}>, dls array<bigint>"


def numbered(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each id among the different ones in their order (null first), and those."""
    unique = pc.unique(ids)
    unique = unique.take(pc.sort_indices(unique, null_placement="at_start"))
    return pc.index_in(ids, value_set=unique).to_numpy(zero_copy_only=False).astype(np.int64), unique


def segments(batches: Iterator[pa.RecordBatch], avgdl: float, places: bool) -> Iterator[pa.RecordBatch]:
    """The blocks of each segment: of rows (id, dl, terms, tfs, at, seg) in the order of seg."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        seg = b.column("seg").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(seg)) + 1), len(seg)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and held[-1].column("seg")[0].as_py() != seg[i]:
                yield from blocks_of(pa.Table.from_batches(held).combine_chunks(), avgdl, places)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield from blocks_of(pa.Table.from_batches(held).combine_chunks(), avgdl, places)


def blocks_of(t: pa.Table, avgdl: float, places: bool) -> Iterator[pa.RecordBatch]:
    one = lambda c: c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)
    flat = lambda name: pc.list_flatten(one(t.column(name)))
    seg, ids = t.column("seg")[0].as_py(), one(t.column("id"))
    dl = one(t.column("dl")).fill_null(0).to_numpy(zero_copy_only=False)
    number, unique = numbered(ids)
    names = ["term", "level", "seg", "hi", "n", "rows", "parts", "at", "ids", "dls"]
    whole_numbers, ids_type = pa.list_(pa.int32()), pa.list_(ids.type)
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), whole_numbers, pa.list_(pa.float64()), whole_numbers, ids_type, pa.list_(pa.int64())]

    def out(columns: dict, n: int) -> pa.RecordBatch:
        columns["seg"] = pa.array(np.full(n, seg), pa.int64())
        return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(n, k)).cast(k) for x, k in zip(names, kinds, strict=True)], names)

    def lists(name: str, code: np.ndarray, level: np.ndarray, row: np.ndarray, value: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Entries in order, their values under a name; a block wherever the key changes."""
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(key)) if len(key) else begin
        for i in range(0, len(begin), 20_000):
            a, z = begin[i : i + 20_000], ends[i : i + 20_000]
            lo, up = a[0], z[-1]
            offsets = pa.array((np.append(a, up) - lo).astype(np.int32))
            rows, values = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (row[lo:up].astype(np.int32), value[lo:up]))
            yield out({"term": words.take(pa.array(code[a])), "level": pa.array(level[a].astype(np.int32)), "hi": pa.array(np.maximum.reduceat(value[lo:up], a - lo)), "n": pa.array(z - a), "rows": rows, name: values}, len(a))

    whole = pa.array([0, len(unique)], pa.int32())
    yield out({"level": pa.array([-1]), "ids": pa.ListArray.from_arrays(whole, unique)}, 1)
    encoded = flat("terms").dictionary_encode()
    words, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = pc.list_parent_indices(one(t.column("terms"))).to_numpy(zero_copy_only=False).astype(np.int64)
    tf = flat("tfs").to_numpy(zero_copy_only=False).astype(np.int64)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[own] / avgdl)) if len(tf) else np.zeros(0)
    level = np.minimum(part / (K1 + 1) * LEVELS, LEVELS - 1).astype(np.int64)
    key = code * LEVELS + level
    order = np.lexsort((number[own], key))
    yield from lists("parts", code[order], level[order], number[own][order], part[order], key[order])
    if places:  # rows by id and length: a phrase counts rows so
        pairs, of = np.unique(number * (dl.max() + 1) + dl, return_inverse=True)
        spot = flat("at").to_numpy(zero_copy_only=False).astype(np.int64)
        code, own = np.repeat(code, tf), np.repeat(of[own], tf)
        order = np.lexsort((spot, own, code))
        yield from lists("at", code[order], np.full(len(order), -1), own[order], spot[order].astype(np.int32), code[order])
        held = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), unique.take(pa.array(pairs // (dl.max() + 1))))
        lengths = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs % (dl.max() + 1)))
        yield out({"level": pa.array([-2]), "ids": held, "dls": lengths}, 1)


def best(score: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which n entries are best by rounded score and then row (in the order of ids)."""
    score = np.round(score, 6)
    keep = np.arange(len(score)) if len(score) <= n else np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    return keep[np.lexsort((row[keep], -score[keep]))[:n]]


class Segment:
    """The postings of a segment by term and row, and the queries that meet it."""

    def __init__(self, mine: pa.Table, theirs: pa.Table, pairs: bool):
        one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.nulls(0, c.type)
        term = one(mine.column("term"))
        head = pc.and_(pc.is_null(term), pc.is_valid(one(mine.column("dls"))) if pairs else pc.is_null(one(mine.column("dls"))))
        head = mine.filter(head)
        held = mine.filter(pc.is_valid(term))
        self.ids = pc.list_flatten(one(head.column("ids")))
        self.dls = pc.list_flatten(one(head.column("dls"))).to_numpy(zero_copy_only=False) if pairs else None
        encoded = one(held.column("term")).dictionary_encode()
        rows = one(held.column("rows"))
        code = np.repeat(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
        row, part = (pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (rows, one(held.column("at" if pairs else "parts"))))
        width = int(row.max(initial=0)) + 1
        order = np.lexsort((part, row, code)) if pairs else np.argsort(code * width + row, kind="stable")  # blocks are in order already
        self.row, self.part = row[order].astype(np.int64), part[order]
        self.single = not pairs and bool(np.all(np.diff(code[order] * width + self.row) > 0))
        self.begin = np.searchsorted(code[order], np.arange(len(encoded.dictionary) + 1))
        asked_for = one(theirs.column("query_id")).dictionary_encode()
        self.queries = asked_for.dictionary
        query = asked_for.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        t = pc.fill_null(pc.index_in(one(theirs.column("term")), value_set=encoded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(query, kind="stable")[t[np.argsort(query, kind="stable")] >= 0]
        self.term, self.theirs = t[order], theirs.take(pa.array(order))
        cuts = np.searchsorted(query[order], np.arange(len(self.queries) + 1))
        self.cuts = [(q, i, j) for q, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
        self.out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def together(self, terms: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have all terms, and the sums of their parts: those of the rarest term, looked up in the others' lists."""
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms[np.argsort(self.begin[terms + 1] - self.begin[terms], kind="stable")]]
        near, score = self.row[spans[0]], part[spans[0]]
        for x in spans[1:]:
            there = self.row[x]
            at = np.minimum(np.searchsorted(there, near), len(there) - 1)
            met = there[at] == near
            near, score = near[met], score[met] + part[x][at[met]]
        return near, score

    def numbers(self, name: str) -> np.ndarray:
        return self.theirs.column(name).to_numpy()

    def put(self, query: int, row: np.ndarray, value: np.ndarray) -> None:
        self.out.append((query, row, value))

    def table(self, name: str) -> pa.Table:
        if not self.out:
            return pa.table([self.queries.slice(0, 0), self.ids.slice(0, 0), pa.array([], pa.float64())], ["query_id", "id", name])
        query = np.repeat([q for q, _, _ in self.out], [len(r) for _, r, _ in self.out])
        row, value = (np.concatenate([x[i] for x in self.out]) for i in (1, 2))
        ids = self.ids.take(pa.array(row, mask=row < 0))
        return pa.table([self.queries.take(pa.array(query)), ids, pa.array(value)], ["query_id", "id", name])


#: Terms of a segment that also get a vector over its rows, the most frequent ones.
VECTORS = 256


def scorer(n: int, every: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The n best rows of a segment for each query. Where all words must be met, the rows of the rarest one are looked up in the
    lists of the others. Where any may, the rows of a question's rarer words are summed up; its frequent words can add
    only so much, so they are looked up where that may lead into the n best."""

    def work(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        s = Segment(mine, theirs, False)
        size, idf, terms = len(s.ids), s.numbers("idf"), s.numbers("terms")
        count = np.diff(s.begin)
        weight = np.zeros(len(count))
        weight[s.term] = idf
        part = s.part * np.repeat(weight, count)
        slot = np.full(len(count), -1)
        often = np.argsort(-count, kind="stable")[:VECTORS]
        often = often[count[often] >= max(64, size / 16)] if not every else often[:0]
        slot[often] = np.arange(len(often))
        vectors = np.zeros((len(often), size))
        for k, t in enumerate(often):
            a, z = s.begin[t], s.begin[t + 1]
            vectors[k] = np.bincount(s.row[a:z], part[a:z], size)
        tops = vectors.max(axis=1) if len(often) else np.zeros(0)
        for q, i, j in s.cuts:
            mine_t = s.term[i:j]
            if every and s.single:
                if j - i == terms[i]:
                    near, score = s.together(mine_t, part)
                    kept = best(score, near, n)
                    s.put(q, near[kept], score[kept])
                continue
            rare, many = mine_t[slot[mine_t] < 0], slot[mine_t][slot[mine_t] >= 0]
            spans = [slice(s.begin[t], s.begin[t + 1]) for t in rare]
            row = np.concatenate([s.row[x] for x in spans]) if spans else np.zeros(0, np.int64)
            add = np.concatenate([part[x] for x in spans]) if spans else np.zeros(0)
            if len(row) * 8 < size and not len(many):
                near, own = np.unique(row, return_inverse=True)
                score = np.bincount(own, add, len(near))
                if every:
                    met = np.bincount(own, minlength=len(near)) == terms[i]
                    near, score = near[met], score[met]
            else:
                score = np.bincount(row, add, size).astype(np.float64)  # of nothing it counts in integers
                near = np.flatnonzero(np.bincount(row, minlength=size) == terms[i]) if every else None
                if len(many):
                    rest = tops[many].sum()
                    least = np.partition(score, size - n)[size - n] - SLACK if size > n else 0.0
                    near = np.flatnonzero(score >= least - rest) if rest < least else None
                    if near is not None and len(near) * 8 < size:
                        score[near] += vectors[np.ix_(many, near)].sum(axis=0)
                    else:
                        for k in many:
                            score += vectors[k]
                if near is None:
                    near = np.flatnonzero(score > 0)
                score = score[near]
            kept = best(score, near, n)
            s.put(q, near[kept], score[kept])
        return s.table("score")

    return work


def packed(mine: pa.Table) -> pa.Table:
    """A segment as one row: its terms, where each one's entries end, and the entries' rows and parts in order."""
    one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.nulls(0, c.type)
    held = mine.filter(pc.is_valid(mine.column("term")))
    ids = pc.list_flatten(one(mine.filter(pc.is_null(mine.column("term"))).column("ids")))
    encoded, rows = one(held.column("term")).dictionary_encode(), one(held.column("rows"))
    code = np.repeat(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
    row, part = (pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (rows, one(held.column("parts"))))
    order = np.lexsort((row, code))
    code, row, part = code[order], row[order], part[order]
    first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(row) != 0))) if len(code) else np.zeros(0, np.int64)
    code, row, part = code[first], row[first], np.add.reduceat(part, first) if len(first) else part  # rows that repeat an id
    ends = np.searchsorted(code, np.arange(len(encoded.dictionary)), side="right")
    lists = [encoded.dictionary, pa.array(ends.astype(np.int32)), pa.array(row), pa.array(part), ids]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.table([mine.column("seg").slice(0, 1).cast(pa.int64()), *lists], ["seg", "terms", "ends", "rows", "parts", "ids"])


def passer(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The n best rows of a segment for each query of a row of queries, of those that reach the query's least score. Frequent
    words are summed as a product of matrices, for some queries at a time, and a query's rarer words by their lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = None
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                if one.column(0)[0].as_py() != seg:
                    seg, (terms, ends, row, part, ids) = one.column(0)[0].as_py(), (pc.list_flatten(one.column(k)) for k in range(1, 6))
                    ends, row = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ends, row))
                    part, count, size = part.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0), len(ids)
                    begin = ends - count
                queries, words, least = pc.list_flatten(one.column(6)).flatten()
                least = pc.fill_null(least, -np.inf).to_numpy(zero_copy_only=False)
                asked, idf = pc.list_flatten(words).flatten()
                term = pc.fill_null(pc.index_in(asked, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                own = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)[term >= 0]
                weight = np.zeros(len(count))
                weight[term[term >= 0]], term = idf.to_numpy(zero_copy_only=False)[term >= 0], term[term >= 0]
                scaled = part * np.repeat(weight, count)
                top = np.maximum.reduceat(scaled, begin) if len(begin) else np.zeros(0)
                reach = np.bincount(own, top[term], len(queries))[own] >= least[own] if len(own) else np.zeros(0, bool)
                own, term = own[reach], term[reach]
                often = np.unique(term)
                often = often[count[often] >= max(64, size / 16)]
                often = often[np.argsort(-count[often], kind="stable")][:VECTORS]
                slot, vectors = np.full(len(count), -1), np.zeros((len(often), size))
                slot[often] = np.arange(len(often))
                for k, t in enumerate(often):
                    vectors[k] = np.bincount(row[begin[t] : ends[t]], scaled[begin[t] : ends[t]], size)
                live = np.unique(own)
                cuts, out = np.searchsorted(own, np.append(live, len(queries))), []
                step = max(1, SCORES // max(1, size))
                for a in range(0, len(live), step):
                    some = live[a : a + step]
                    lo, up = cuts[a], cuts[a + len(some)]
                    at = slot[term[lo:up]]
                    chosen = np.zeros((len(some), len(often)))
                    chosen[np.searchsorted(some, own[lo:up][at >= 0]), at[at >= 0]] = 1
                    scores = chosen @ vectors
                    for k, q in enumerate(some):
                        mine = term[cuts[a + k] : cuts[a + k + 1]]
                        spans, score = [slice(begin[t], ends[t]) for t in mine[slot[mine] < 0]], scores[k]
                        if spans:
                            score += np.bincount(np.concatenate([row[x] for x in spans]), np.concatenate([scaled[x] for x in spans]), size)
                        near = np.flatnonzero(score >= least[q] if np.isfinite(least[q]) else score > 0)
                        kept = best(score[near], near, n)
                        out.append((q, near[kept], np.round(score[near[kept]], 6)))
                if out:
                    whose = np.repeat([q for q, _, _ in out], [len(r) for _, r, _ in out])
                    rows, values = (np.concatenate([x[k] for x in out]) for k in (1, 2))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(whose)), ids.take(pa.array(rows)), pa.array(values)], ["query_id", "id", "score"])

    return work


def phraser(n: int, avgdl: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The n best rows of a segment that hold each phrase, or (n = 0) how many hold it."""

    def work(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        s = Segment(mine, theirs, True)
        offset, words = s.numbers("offset").astype(np.int64), s.numbers("words")
        width = int(s.dls.max(initial=0)) + int(offset.max(initial=0)) + 2
        key, place = s.row * width + s.part.astype(np.int64), s.part.astype(np.int64)
        idf = s.numbers("idf") if n else None
        for q, i, j in s.cuts:
            if j - i < words[i]:
                continue
            order = i + np.argsort(s.begin[s.term[i:j] + 1] - s.begin[s.term[i:j]], kind="stable")
            first = slice(s.begin[s.term[order[0]]], s.begin[s.term[order[0]] + 1])
            at = (key[first] - offset[order[0]])[place[first] >= offset[order[0]]]
            for k in order[1:]:
                there = key[s.begin[s.term[k]] : s.begin[s.term[k] + 1]]
                want = at + offset[k]
                at = at[there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want]
            row, tf = np.unique(at // width, return_counts=True)
            if not len(row):
                continue
            if not n:
                s.put(q, np.array([-1]), np.array([float(len(row))]))
                continue
            score = idf[i] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * s.dls[row] / avgdl))
            kept = best(score, row, n)
            s.put(q, row[kept], score[kept])
        return s.table("part")

    return work


def asked(queries: DataFrame) -> DataFrame:
    """query_id, term: the different terms of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def bucket_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def equals(term: str):
    return lambda x: x == term


def tokens_of(query: str) -> list[str]:
    """The query's terms; runs of letters and digits, lower case, without the diacritics of the index."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", query.lower().translate(str.maketrans(ACCENTED, PLAIN)))


def bm25_phrase(rows: DataFrame, phrase: str, id_col: str, text_col: str, n: int = 50) -> DataFrame:
    """id, score of rows that hold the words next to one another; the phrase counts as one term."""
    words = tokens_of(phrase)
    d = rows.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    spaced = F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" "))
    d = d.select("id", F.size("t").alias("dl"), F.regexp_count(spaced, F.lit(f"(?= {' '.join(words)} )")).cast("double").alias("tf"))
    s = d.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("dl").alias("avgdl"), F.sum((F.col("tf") > 0).cast("double")).alias("k"))
    idf = F.greatest(F.ln((F.col("n_rows") - F.col("k") + 0.5) / (F.col("k") + 0.5)), F.lit(FLOOR))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return d.where("tf > 0").join(F.broadcast(s)).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)
