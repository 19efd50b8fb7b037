"""What the operators share: scratch tables, checked broadcasts, and word hashing over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs of anything but ASCII white space (a Java regular expression).
WORDS = r"[^\x20\x09-\x0D]+"
#: Used only where a local session has no spark.checkpoint.dir (tests, notebooks).
DEFAULT_SCRATCH = "/tmp/checkpoints/tessera"
#: Rows that a side may have to be broadcast; above it joins are shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of text that one vectorised step looks at (a longer text is its own step).
STEP_BYTES = 1_000_000
#: Spark's setting that removes the shuffle files of an execution at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session, whose executors share one disk, may have none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or DEFAULT_SCRATCH).rstrip("/")


#: The tables written inside each open scratch(), the innermost last.
_open: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The shuffle files of the write go when it has ended, since nothing reads them again; other executions keep theirs.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are materialized inside go at the end, but for those written by the function that it gives."""
    mine: list[str] = []
    _open.append(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        path = mine.pop()
        for outer in _open[-2:-1]:
            outer.append(path)
        return out

    try:
        yield keep
    finally:
        _open.remove(mine)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def shielded(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed to c0, c1, ... in their order, and the new names of the columns `named`.

    So no name that an operator gives inside can meet one of the input's, and names that repeat do no harm.
    """
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [f"c{docs.columns.index(n)}" for n in named]


def restored(out: DataFrame, docs: DataFrame, added: Sequence[str], *without: str) -> DataFrame:
    """out, made from shielded(docs), with docs' columns under their own names and the added ones behind them. Columns of
    docs named like an added one, in capitals or not, are replaced; those shielded as `without` are left out."""
    keep = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in added and f"c{i}" not in without]
    return out.select(*(k for k, _ in keep), *added).toDF(*(c for _, c in keep), *added)


def limit_arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on in this session: texts are long, and each task holds some batches,
    in the JVM beside its heap and in Python. The setting must still hold when a returned DataFrame runs, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (looked up, at most rows + 1 are counted), else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_hash(df: DataFrame, text_col: str = "text"):
    """Tells apart rows that repeat a doc_id with another text. Null texts hash like empty ones do."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


# --- vectorised words -------------------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i mod 2**64 for i < n."""
    if len(_POW[0]) < n:
        for k, p in enumerate((_P, _PINV)):
            a = np.full(max(n, STEP_BYTES + 1024), p, np.uint64)
            a[0] = 1
            _POW[k] = np.cumprod(a, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def segments_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of buf[starts[i]:ends[i]]; segments are in order and do not overlap.

    live: which bytes count; those between segments must not. Without it they are masked here.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    pw, inv = powers(len(buf) + 1)
    t = (buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)]
    if live is None:
        edge = np.zeros(len(buf) + 1, np.int8)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        live = np.cumsum(edge[:-1], dtype=np.int8) > 0
    t[~live] = 0
    t = np.append(t, np.uint64(0))
    s = np.add.reduceat(t, starts)
    s[starts == ends] = 0
    return mix(s * inv[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: `hash` of each word, `first[i]:first[i+1]` are those of text i.

    `start` and `end` are byte ranges in `buf`, the texts joined by a newline; text i is buf[at[i]:at[i]+size[i]].
    """

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1].astype(np.int64)
        ws = _WS[self.buf] if len(self.buf) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], ws, [True]]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = segments_hash(self.buf, self.start, self.end, ~ws)
        self.first = np.append(np.searchsorted(self.start, self.at), len(self.start))

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """For each word, its text's index."""
        return np.repeat(np.arange(len(self.size)), self.count())


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each position on; len(h) - n + 1 of them (none if h is shorter)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    have, size, done, out = h, 1, 0, None
    bits = n
    pw = {1: _P}
    while bits:
        if bits & 1:
            part = have[done : len(h) - n + 1 + done]
            out = part.copy() if out is None else out * pw[size] + part
            done += size
        bits >>= 1
        if bits:
            m = len(h) - 2 * size + 1
            have = have[:m] * pw[size] + have[size : size + m]
            pw[2 * size] = np.uint64((int(pw[size]) ** 2) & ((1 << 64) - 1))
            size *= 2
    return mix(out)


def steps(batch: pa.RecordBatch, text: str = "text"):
    """(rows, texts as bytes) of a batch in steps of about STEP_BYTES; a null text gives b''."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
    cuts, total = [0], 0
    for i, n in enumerate(sizes):
        if total and total + n > STEP_BYTES:
            cuts.append(i)
            total = 0
        total += int(n)
    for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        if b > a:
            yield slice(a, b), [x or b"" for x in col.slice(a, b - a).to_pylist()]
