"""Merkle fixity audit of WARC records.

A record's bytes (header, payload) are hashed; records are filed by number. Records that are made from a table of pages have
`PER_FILE` slots a file; those read from WARC files keep their file and their place in it. A file's slots are the
leaves of a tree in which every node hashes the ordered digests of up to `FAN` children and the offset range they cover,
so that its root stands for all bytes of the file in their order. Two replicas are compared by root; only below nodes that
differ are their children compared, level by level, until the records that differ are named.

Offsets are running sums inside one file, whose number of slots is fixed. All is done in DataFrame functions; a comparison
joins on (file, node), rows are spread evenly.

Defined cases: what does not parse as a record ends its file, and the rest of it is one record of its own; an empty table, or a
file without records, has no tree; columns of the pages beyond the three that are named have no effect, whatever their names;
payloads of any length are hashed whole; a slot that holds several records (repeated ids) hashes them in the order of their digests; records without
an id have no slot and are not audited; a null url or payload counts as empty; an empty replica has no roots, so that all of
the other's records are missing in it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

PER_FILE = 1000
FAN = 16
#: Levels above the leaves: FAN ** LEVELS >= PER_FILE.
LEVELS = 3


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """file, slot, id, length, digest of each page as a WARC response record."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col(id_col).cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(header, payload, F.lit("\r\n\r\n"))
    n = F.col(id_col).cast("long")
    file = F.floor(n / PER_FILE).cast("long")
    return pages.where(n.isNotNull()).select(file.alias("file"), F.pmod(n, F.lit(PER_FILE)).alias("slot"), n.alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def parsed(data: bytes) -> Iterator[tuple[str | None, str | None, bytes]]:
    """(id, target, bytes) of the records of an uncompressed WARC file, in order; bytes are header and block without the blank
    lines behind them. What does not parse is one last record without an id."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", data[at : head + 2]) if head >= 0 else None
        if not data.startswith(b"WARC/", at) or size is None or head + 4 + int(size.group(1)) > len(data):
            yield None, None, data[at:]
            return
        end = head + 4 + int(size.group(1))
        field = lambda name: m.group(1).decode("utf-8", "replace") if (m := re.search(rb"(?im)^" + name + rb":[ \t]*(.*?)[ \t]*\r?$", data[at : head + 2])) else None  # noqa: B023, E731
        yield field(b"warc-record-id"), field(b"warc-target-uri"), data[at:end]
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, slot, record_id, target, offset, length, digest of the records of WARC files (.warc, .warc.gz) below a path.

    Offsets are those of the uncompressed file. A file is a row of Spark's reader, so one task holds it (up to 2 GB).
    """
    schema = "file string, slot long, record_id string, target string, offset long, length long, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, offset = [], 0
                for slot, (record, target, body) in enumerate(parsed(data)):
                    offset = data.index(body, offset)
                    rows.append((file, slot, record, target, offset, len(body), hashlib.sha256(body).hexdigest()))
                    offset += len(body)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "slot", "record_id", "target", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.warc(\.gz)?$"))
    name = F.regexp_extract("path", "([^/]+)$", 1)  # replicas have other folders
    return files.select(name.alias("file"), "content").mapInArrow(run, schema)


def tree(recs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """file, level, node, start, end (bytes of the file), hash. Level 0 are the slots that hold records; FAN ** levels is at
    least the slots of a file."""
    one = recs.groupBy("file", "slot").agg(F.sum("length").alias("length"), F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("hash"))
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    level = one.withColumn("start", start).select("file", F.lit(0).alias("level"), F.col("slot").alias("node"), "start", (F.col("start") + F.col("length")).alias("end"), "hash")
    out = level = materialize(level, "warc-leaves")
    for k in range(1, levels + 1):
        child = F.struct("node", "start", "end", "hash")
        level = level.groupBy("file", F.floor(F.col("node") / FAN).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(child)).alias("c"))
        parts = F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"], x["end"] - x["start"]))
        level = level.select("file", F.lit(k).alias("level"), "node", "start", "end", F.sha2(F.array_join(parts, "\n"), 256).alias("hash"))
        out = out.unionByName(level)
    return materialize(out, "warc-tree")


def audit(ours: DataFrame, theirs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """file, slot, kind (altered, missing, extra), start, end of the slots of `theirs` that differ; both are trees of as many levels."""
    suspects = None
    for k in range(levels, -1, -1):
        a = ours.where(F.col("level") == k).select("file", "node", "start", "end", "hash")
        b = theirs.where(F.col("level") == k).select("file", "node", F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("hash").alias("hash_b"))
        if suspects is not None:
            up = F.floor(F.col("node") / FAN)
            a, b = (x.join(suspects, (F.col("file") == F.col("_f")) & (up == F.col("_n")), "left_semi") for x in (a, b))
        differ = a.join(b, ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("hash_b")))
        differ = materialize(differ, "warc-differ")
        suspects = differ.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("altered")
    return differ.select("file", F.col("node").alias("slot"), kind.alias("kind"), F.coalesce("start", "start_b").alias("start"), F.coalesce("end", "end_b").alias("end"))
