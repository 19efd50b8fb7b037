"""The index as tables: a keyed log store, with upserts by file, compaction, export and import."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("files", "chunks", "symbols", "imports", "edges", "embeddings", "docs")
#: What a table is dealt to buckets by, if nothing else is named: the first of these that it has.
OWNERS = ("file_id", "source", "src", "doc_id")
#: Buckets of a new table, and the entries of a bucket at which a change compacts it.
BUCKETS, MOST = 16, 8
#: The format of manifests; MIGRATIONS rewrite those of an earlier one, step by step.
FORMAT = 2
MIGRATIONS: dict[int, Callable[[dict], dict]] = {
    #: Format 1 had one unbucketed folder a table and no log.
    1: lambda m: {**m, "format": 2, "owner": None, "buckets": 1, "entries": [{"rows": m["path"], "gone": None, "at": None, "seq": 0}]},
}


class Conflict(RuntimeError):
    """Another writer has changed what a commit would have replaced."""


class Store:
    """Tables below a root. A table is a log: entries of rows and of owners whose earlier rows are gone, dealt to buckets by a
    hash of the owner.

    A manifest names the entries of each bucket. A change writes files for its own buckets only, then a manifest with the next
    number, by a rename that fails where another writer has taken the number; the change is then put on top of the new one,
    so that no writer's rows are lost. Readers see one manifest or another. A row is there if no later entry of its bucket names
    its owner among the gone. A bucket with MOST entries is compacted into one.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- manifests

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, fs = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _text(self, path: str) -> str:
        at, fs = self._fs(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self, table: str) -> int:
        """The number of the current manifest; 0 for a table of format 1, -1 where there is none."""
        numbers = [int(x[:-5]) for x in self._names(f"{self.root}/{table}/manifests") if x.endswith(".json") and x[:-5].isdigit()]
        if numbers:
            return max(numbers)
        at, fs = self._fs(f"{self.root}/{table}/current")
        return 0 if fs.exists(at) else -1

    def exists(self, table: str) -> bool:
        return self.version(table) >= 0

    def manifest(self, table: str) -> dict:
        """version, format, schema, owner, buckets, entries (rows, gone: folders; at: buckets, None for all; seq)."""
        n = self.version(table)
        if n < 0:
            raise FileNotFoundError(f"no table {table!r} in {self.root}")
        if n == 0:
            path = self._text(f"{self.root}/{table}/current").strip()
            m = {"version": 0, "format": 1, "path": path, "schema": json.loads(self.spark.read.parquet(path).schema.json())}
        else:
            m = json.loads(self._text(f"{self.root}/{table}/manifests/{n:012d}.json"))
        if m["format"] > FORMAT:
            raise ValueError(f"table {table!r} has format {m['format']}, newer than {FORMAT}")
        while m["format"] < FORMAT:
            m = MIGRATIONS[m["format"]](m)
        return m

    def _commit(self, table: str, m: dict) -> bool:
        """Write m as the manifest after the version it was made from; False if another writer has."""
        m = {**m, "version": m["version"] + 1}
        home = f"{self.root}/{table}/manifests"
        at, fs = self._fs(f"{home}/{uuid.uuid4().hex}.tmp")
        out = fs.create(at)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        to = jvm.org.apache.hadoop.fs.Path(f"{home}/{m['version']:012d}.json")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(at, to, none)
        except Exception as e:
            fs.delete(at, False)
            if "FileAlreadyExists" in str(e) or fs.exists(to):
                return False
            raise
        return True

    def _change(self, table: str, change: Callable[[dict], dict]) -> None:
        """Commit change(manifest), again on each newer manifest until no other writer comes between."""
        while not self._commit(table, change(self.manifest(table))):
            pass

    # --- files

    def _bucket(self, owner: str | None, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(owner).cast("string")), F.lit(buckets)).cast("int") if owner else F.lit(0)

    def _put(self, table: str, df: DataFrame, owner: str | None, buckets: int) -> tuple[str, list[int]]:
        """Write rows by bucket; gives the folder and the buckets that it has. Large buckets are split, small ones joined."""
        path = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket(owner, buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        return path, sorted(int(x[8:]) for x in self._names(path) if x.startswith("_bucket="))

    def _files(self, folder: str, at: list[int] | None, schema: StructType | str) -> DataFrame:
        paths = [folder] if at is None else [f"{folder}/_bucket={k}" for k in at]
        have = set(self._names(folder)) if at is not None else set()
        paths = [p for p in paths if at is None or p.rsplit("/", 1)[1] in have]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def load(self, table: str) -> DataFrame:
        return self._visible(self.manifest(table))

    def _visible(self, m: dict, only: set[int] | None = None) -> DataFrame:
        """The rows of a manifest, of some buckets or all."""
        schema, owner = StructType.fromJson(m["schema"]), m["owner"]
        wanted = lambda e: None if e["at"] is None else [k for k in e["at"] if only is None or k in only]
        rows = [(e, wanted(e)) for e in m["entries"] if e["rows"]]
        gone = [(e, wanted(e)) for e in m["entries"] if e["gone"]]
        gone = [(e, at) for e, at in gone if at]
        dirty = lambda e, at: {k for g, to in gone if g["seq"] > e["seq"] for k in to} if at is None else {k for g, to in gone if g["seq"] > e["seq"] for k in to} & set(at)
        parts, touched = [], []
        for e, at in rows:
            if at == []:
                continue
            if at is None and only is not None:
                raise ValueError("an entry without buckets can't be read by bucket")
            hit = dirty(e, at)
            clean = at if at is None else [k for k in at if k not in hit]
            if at is None and hit:
                touched.append(self._files(e["rows"], None, schema).withColumn("_seq", F.lit(e["seq"])))
            elif clean is None or clean:
                parts.append(self._files(e["rows"], clean, schema))
            if at is not None and hit:
                touched.append(self._files(e["rows"], sorted(hit), schema).withColumn("_seq", F.lit(e["seq"])))
        if touched:
            field = next(f for f in schema.fields if f.name == owner)
            key = StructType([field])
            out = None
            for e, at in gone:
                d = self._files(e["gone"], at, key).withColumn("_since", F.lit(e["seq"]))
                out = d if out is None else out.unionByName(d)
            since = out.groupBy(F.col(owner).alias("_owner")).agg(F.max("_since").alias("_since"))
            live = touched[0]
            for d in touched[1:]:
                live = live.unionByName(d)
            live = live.join(since, (F.col(owner) == F.col("_owner")) & (F.col("_since") > F.col("_seq")), "left_anti")
            parts.append(live.drop("_seq"))
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for d in parts[1:]:
            out = out.unionByName(d)
        return out

    def lookup(self, table: str, owners: DataFrame) -> DataFrame:
        """The rows of some owners (a column named as the table's owner): only the buckets that these fall in are read."""
        m = self.manifest(table)
        if m["owner"] not in owners.columns:
            raise ValueError(f"{table!r} is kept by {m['owner']!r}")
        wanted = owners.select(F.col(m["owner"]).cast(StructType.fromJson(m["schema"])[m["owner"]].dataType)).distinct()
        if any(e["at"] is None for e in m["entries"]):
            return self._visible(m).join(wanted, m["owner"], "left_semi")
        at = {r[0] for r in wanted.select(self._bucket(m["owner"], m["buckets"])).distinct().collect()}  # numbers of buckets
        return self._visible(m, at).join(wanted, m["owner"], "left_semi")

    # --- changes

    def save(self, table: str, df: DataFrame, owner: str | None = None, expect: int | None = None) -> None:
        """Replace the whole table. With expect, the version that df was made from: Conflict if there is a newer one."""
        owner = owner or next((c for c in OWNERS if c in df.columns), None)
        buckets = self.buckets if owner else 1
        path, at = self._put(table, df, owner, buckets)
        while True:
            n = self.version(table)
            if expect is not None and n != expect:
                raise Conflict(f"{table!r} is at version {n}, not {expect}")
            m = {"version": max(n, 0), "format": FORMAT, "schema": json.loads(df.schema.json()), "owner": owner, "buckets": buckets, "entries": [{"rows": path, "gone": None, "at": at, "seq": max(n, 0) + 1}]}
            if self._commit(table, m):
                return

    def replace_files(self, table: str, rows: DataFrame, owner: str = "file_id", owners: DataFrame | None = None) -> None:
        """Put rows in the place of all rows of their owners, or of those in `owners`."""
        if not self.exists(table):
            return self.save(table, rows, owner)
        self._log(table, rows, (rows if owners is None else owners).select(owner), owner)

    def delete_files(self, table: str, owners: DataFrame, owner: str = "file_id") -> None:
        self._log(table, None, owners.select(owner), owner)

    def _log(self, table: str, rows: DataFrame | None, gone: DataFrame | None, owner: str) -> None:
        """Append an entry to the buckets of these rows and owners."""
        m = self.manifest(table)
        if m["owner"] != owner:
            m = self._rebucket(table, owner)
        schema = StructType.fromJson(m["schema"])
        entry: dict = {"rows": None, "gone": None, "at": []}
        for name, d in (("rows", rows), ("gone", gone)):
            if d is not None:
                fields = schema.fields if name == "rows" else [f for f in schema.fields if f.name == owner]
                d = d.select(*(F.col(f.name).cast(f.dataType) for f in fields))
                entry[name], at = self._put(table, d if name == "rows" else d.where(F.col(owner).isNotNull()).distinct(), owner, m["buckets"])
                entry["at"] = sorted({*entry["at"], *at})
        if not entry["at"]:
            return

        def add(now: dict) -> dict:
            if (now["owner"], now["buckets"], now["schema"]) != (m["owner"], m["buckets"], m["schema"]):
                raise Conflict(f"{table!r} has been saved with another layout")
            return {**now, "entries": [*now["entries"], {**entry, "seq": now["version"] + 1}]}

        self._change(table, add)
        self.compact(table, MOST)

    def add(self, table: str, rows: DataFrame, owner: str) -> None:
        """Add rows to what their owners have."""
        self._log(table, rows, None, owner) if self.exists(table) else self.save(table, rows, owner)

    def append(self, table: str, rows: DataFrame, key: str) -> None:
        """Add the rows whose key the table does not hold; of rows that repeat a key one is added."""
        new = rows.dropDuplicates([key])
        if not self.exists(table):
            return self.save(table, new, key)
        while True:
            m = self.manifest(table)
            if m["owner"] != key:
                m = self._rebucket(table, key)
            schema = StructType.fromJson(m["schema"])
            more = new.join(self._visible(m).select(key), key, "left_anti")
            path, at = self._put(table, more.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)), key, m["buckets"])
            if not at or self._commit(table, {**m, "entries": [*m["entries"], {"rows": path, "gone": None, "at": at, "seq": m["version"] + 1}]}):
                break  # else another writer may have added some of these keys: look again
        self.compact(table, MOST)

    def _rebucket(self, table: str, owner: str) -> dict:
        """Deal the whole table to buckets by another owner; gives the new manifest."""
        while True:
            n = self.version(table)
            try:
                self.save(table, self._visible(self.manifest(table)), owner, expect=n)
            except Conflict:
                continue
            return self.manifest(table)

    def compact(self, table: str, most: int = 1) -> list[int]:
        """Rewrite the buckets that have more than `most` entries as one; gives their numbers. Changes that other writers commit
        meanwhile stay behind it."""
        while True:
            m = self.manifest(table)
            if any(e["at"] is None for e in m["entries"]):
                return []
            counts = {k: sum(k in e["at"] for e in m["entries"]) for k in range(m["buckets"])}
            full = {k for k, n in counts.items() if n > most}
            if not full:
                return []
            path, at = self._put(table, self._visible(m, full), m["owner"], m["buckets"])
            seen = {json.dumps(e, sort_keys=True) for e in m["entries"]}
            last = max(e["seq"] for e in m["entries"])

            def swap(now: dict, m=m, path=path, at=at, seen=seen, last=last, full=full) -> dict:
                if not seen <= {json.dumps(e, sort_keys=True) for e in now["entries"]}:
                    raise Conflict("compacted meanwhile")
                kept = [{**e, "at": [k for k in e["at"] if k not in full]} if e["seq"] <= last else e for e in now["entries"]]
                return {**now, "entries": [{"rows": path, "gone": None, "at": at, "seq": last}, *(e for e in kept if e["at"])]}

            try:
                self._change(table, swap)
            except Conflict:
                continue
            return sorted(full)

    def clean(self, table: str) -> None:
        """Delete manifests before the current one and the files that it does not name (no reader may still use them, no writer
        be between its files and its commit)."""
        m = self.manifest(table)
        used = {x.rsplit("/", 1)[1] for e in m["entries"] for x in (e["rows"], e["gone"]) if x}
        for name in self._names(f"{self.root}/{table}/data"):
            if name not in used:
                at, fs = self._fs(f"{self.root}/{table}/data/{name}")
                fs.delete(at, True)
        for name in self._names(f"{self.root}/{table}/manifests"):
            if name != f"{m['version']:012d}.json":
                at, fs = self._fs(f"{self.root}/{table}/manifests/{name}")
                fs.delete(at, False)

    def clear(self, *tables: str) -> None:
        """Empty tables of the same columns."""
        for t in tables or TABLES:
            if self.exists(t):
                self.save(t, self.load(t).limit(0), self.manifest(t)["owner"])

    def load_or_empty(self, table: str, schema: str) -> DataFrame:
        return self.load(table) if self.exists(table) else self.spark.createDataFrame([], schema)

    def export_json(self, table: str, path: str) -> None:
        self.load(table).write.mode("overwrite").json(path)

    def import_json(self, table: str, path: str, key: str, merge: bool = True) -> int:
        """Rows of a JSON export, by key; rows without a key are left out. Gives their number."""
        schema = self.load(table).schema if self.exists(table) else None
        rows = (self.spark.read.schema(schema) if schema else self.spark.read).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
        self.replace_files(table, rows, key) if merge else self.save(table, rows, key)
        return rows.count()


def list_pages(spark: SparkSession, root: str) -> DataFrame:
    """page, text of the Markdown pages below root, by path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = os.path.abspath(root)
    return d.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base + "/", "").alias("page"), F.decode("content", "UTF-8").alias("text")).orderBy("page")


def page(spark: SparkSession, root: str, name: str) -> str:
    """One page; names that leave the root raise ValueError, missing ones name the first 20."""
    full = os.path.realpath(os.path.join(root, name))
    if not full.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"{name!r} is outside")
    got = list_pages(spark, root)
    hit = got.where(F.col("page") == name).take(1)
    return hit[0].text if hit else "No such page. There are: " + ", ".join(r.page for r in got.limit(20).collect())
