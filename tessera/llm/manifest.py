"""Merkle manifest of a dataset: a tree of hashes for each group (source), and one over the groups' roots.

Rows become leaves (SHA-256 of their fields) and are put in order by a range partitioning, so that a leaf's place in its group
comes from counts by (group, partition) and no group is gathered. `FAN` consecutive nodes have one parent, and
`FAN ** DEPTH` consecutive leaves are a bucket that is aligned with the tree: it holds the whole of a subtree, or all of a
smaller group. A task gets a bucket as an Arrow table and lets DuckDB build its levels, each one query: string_agg of the
digests in order, then sha256. Spark combines the buckets' roots, which are the leaves of the next tier of buckets, until each
group has one root; the groups' roots are then the leaves of the outer tree, built the same way. On the way down each tier's
buckets are joined (cogrouped) with the proof of their root, so that what travels for a leaf are its digests, never its proof.

Defined cases: a null field is "-"; null groups and null ids come first; leaves with equal ids are in the order of their
digests, and repeated rows are leaves of their own; a field of any length is hashed whole; an empty table gives an empty
result. Names of the input's columns do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, small_side

FAN, DEPTH = 16, 3
BUCKET = FAN**DEPTH
NODES = "g string, pos long, digest string, size long"
PROOFS = "g string, bucket long, subroot string, root string, befores array<string>, afters array<string>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_db = None


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields: each a dash if null, else its bytes, a colon, and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def group_key(c: Column) -> Column:
    """Text that sorts as c does, nulls first, and is never null."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves (g and others) with pos (from 0, in its g by `order`) and size (of its g).

    What is joined to the leaves has a row for each group and partition that holds some of it.
    """
    by = [F.col("g").asc(), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = materialize(ranged.withColumn("n", F.monotonically_increasing_id()), "manifest-ordered")
    part = F.shiftright("n", 33)
    counts = ranged.groupBy("g", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("first"))
    w = Window.partitionBy("g").orderBy("part")
    offsets = counts.select("g", "part", (F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("g")).alias("size"))
    offsets = materialize(offsets, "manifest-offsets")
    return ranged.withColumn("part", part).join(small_side(offsets), ["g", "part"]).withColumn("pos", (F.col("n") + F.col("shift")).cast("long")).drop("n", "part", "shift")


def db():
    """This worker's DuckDB, one thread."""
    global _db
    if _db is None:
        import duckdb

        _db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
    return _db


def levels_of(size: int) -> int:
    """Levels that a bucket of a group of `size` nodes goes up: to the top if that is inside, else DEPTH."""
    n = 0
    while n < DEPTH and FAN**n < size:
        n += 1
    return n


def build(table: pa.Table) -> int:
    """Tables l0, l1, ... of a bucket (pos, digest, size): i (place in the bucket) and digest; gives the last one's number."""
    q = db()
    top = levels_of(table.column("size")[0].as_py())
    q.register("nodes", table.select(["pos", "digest"]))
    q.execute(f"CREATE OR REPLACE TEMP TABLE l0 AS SELECT pos % {BUCKET} AS i, digest FROM nodes")
    q.unregister("nodes")
    for k in range(1, top + 1):
        q.execute(f"CREATE OR REPLACE TEMP TABLE l{k} AS SELECT i // {FAN} AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM l{k - 1} GROUP BY i // {FAN}")
    return top


def bucket_root(table: pa.Table) -> pa.Table:
    """The root of one bucket, as a node of the next tier."""
    top = build(table)
    size = table.column("size")[0].as_py()
    got = db().execute(f"SELECT digest FROM l{top}").fetchall()
    if len(got) != 1:
        raise ValueError("a bucket is not aligned with the tree")
    return pa.table({"g": [table.column("g")[0].as_py()], "pos": pa.array([table.column("pos")[0].as_py() // BUCKET], pa.int64()), "digest": [got[0][0]], "size": pa.array([-(-size // BUCKET)], pa.int64())})


def path_query(top: int) -> str:
    """i, digest, and what stands before and after it in its run (b1, a1), its parent in its (b2, a2), and so on."""
    sides = [
        f"s{k} AS (SELECT i, coalesce(string_agg(digest, '') OVER (PARTITION BY i // {FAN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,"
        f" coalesce(string_agg(digest, '') OVER (PARTITION BY i // {FAN} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM l{k - 1})"
        for k in range(1, top + 1)
    ]
    cols = "".join(f", s{k}.b AS b{k}, s{k}.a AS a{k}" for k in range(1, top + 1))
    joins = "".join(f" JOIN s{k} ON s{k}.i = l0.i // {FAN ** (k - 1)}" for k in range(1, top + 1))
    return ("WITH " + ", ".join(sides) + " " if sides else "") + f"SELECT l0.i, l0.digest{cols} FROM l0{joins}"


def listed(top: int, side: str) -> str:
    return "[" + ", ".join(f"{side}{k}" for k in range(1, top + 1)) + "]::VARCHAR[]"


def descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The proofs of a bucket's nodes, as those of the roots of the tier below; above: the one of the bucket's own root."""
    top, q = build(nodes), db()
    q.register("up", above)
    g, bucket = nodes.column("g")[0].as_py(), nodes.column("pos")[0].as_py() // BUCKET
    got = q.sql(f"SELECT '' AS g, i + {bucket * BUCKET} AS bucket, subroot, root, list_concat({listed(top, 'b')}, befores) AS befores, list_concat({listed(top, 'a')}, afters) AS afters FROM ({path_query(top)}), up").to_arrow_table()
    q.unregister("up")
    return got.set_column(0, "g", pa.array([g] * len(got), pa.string()))


def verify(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """The result's rows of a bucket of leaves (doc_id, tampered besides): each proof, and the root that folding gives."""
    top, q = build(leaves), db()
    q.register("up", above)
    q.register("own", leaves.select(["pos", "doc_id", "tampered"]))
    fold, more = "coalesce(tampered, digest)", len(above.column("befores")[0])
    for k in range(1, top + 1):
        fold = f"sha256(b{k} || {fold} || a{k})"
    text = "".join(f" || b{k} || a{k}" for k in range(1, top + 1)) + "".join(f" || befores[{k}] || afters[{k}]" for k in range(1, more + 1))
    for k in range(1, more + 1):
        fold = f"sha256(befores[{k}] || {fold} || afters[{k}])"
    rows = f"SELECT doc_id, digest AS leaf, subroot, root, sha256(''{text}) AS proof_sha256, {fold} AS folded_root FROM ({path_query(top)}) p JOIN own ON own.pos % {BUCKET} = p.i, up"
    got = q.sql(f"SELECT *, folded_root = root AS verified FROM ({rows})").to_arrow_table()
    q.unregister("up")
    q.unregister("own")
    return got


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """nodes (g, pos, digest, size), the roots of their buckets, the roots of those, ... until each group has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        bucket = F.floor(F.col("pos") / BUCKET)
        up = out[-1].select("g", "pos", "digest", "size", bucket.alias("bucket")).groupBy("g", "bucket").applyInArrow(bucket_root, NODES)
        out.append(materialize(up, "manifest-tier"))
    return out


def proofs(levels: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """The proofs (PROOFS) of the nodes of levels[0]; tops: those of the nodes of levels[-1], g and bucket = pos."""
    for nodes in reversed(levels[:-1]):
        tops = materialize(cogrouped(nodes, tops).applyInArrow(descend, PROOFS), "manifest-proofs")
    return tops


def cogrouped(nodes: DataFrame, above: DataFrame):
    with_bucket = nodes.withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    return with_bucket.groupBy("g", "bucket").cogroup(above.groupBy("g", "bucket"))


def leaves(docs: DataFrame, group_col: str, id_col: str, fields: Sequence[str], tamper: Column | None = None, altered: dict[str, Column] | None = None) -> DataFrame:
    """g, doc_id, digest, tampered (the digest of the row as a tampering hand leaves it; null where `tamper` is not true).
    altered: new values of fields."""
    mine = digest(*(F.col(f) for f in fields))
    theirs = digest(*((altered or {}).get(f, F.col(f)) for f in fields))
    return docs.select(group_key(F.col(group_col)).alias("g"), F.col(id_col).cast("long").alias("doc_id"), mine.alias("digest"), (F.when(tamper, theirs) if tamper is not None else F.lit(None).cast("string")).alias("tampered"))


def manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tamper: Column | None = None, altered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    folded_root is folded from the leaf of the row as tampered with, and the siblings of the untampered tree.
    """
    with scratch(docs.sparkSession) as keep:
        got = placed(materialize(leaves(docs, group_col, id_col, fields, tamper, altered), "manifest-leaves"), "doc_id", "digest")
        got = keep(got.select("g", "pos", "size", "doc_id", "digest", "tampered"), "manifest-placed")
        inner = tiers(got.select("g", "pos", "digest", "size"))
        subroots = inner[-1].select(F.lit("").alias("g"), F.col("g").alias("inner"), "digest")
        outer = materialize(placed(subroots, "inner"), "manifest-outer")
        above = tiers(outer.select("g", "pos", "digest", "size"))
        none = F.array().cast("array<string>")
        root = above[-1].select("g", F.col("pos").alias("bucket"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), none.alias("befores"), none.alias("afters"))
        of_groups = proofs(above, root).withColumnRenamed("bucket", "pos").drop("g", "subroot")
        tops = outer.select("pos", F.col("inner").alias("g"), F.col("digest").alias("subroot")).join(of_groups, "pos")
        tops = tops.select("g", F.lit(0).cast("long").alias("bucket"), "subroot", "root", "befores", "afters")
        last = keep(proofs(inner[1:], tops) if len(inner) > 1 else tops, "manifest-tops")
    return cogrouped(got, last).applyInArrow(verify, RESULT)
