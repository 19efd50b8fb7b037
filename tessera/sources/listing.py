"""Trees of files as a data source: the driver looks at a bounded number of directories, tasks list the rest."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

FORMAT = "file_tree"
SCHEMA = pa.schema([("path", pa.string()), ("suffix", pa.string()), ("size_bytes", pa.int64()), ("last_modified", pa.timestamp("us", "UTC"))])
#: Directories that the driver lists at most, and parts that the subtrees are dealt to at most.
SPREAD = 64
#: Rows of a batch of the listing, and the bytes at which a batch of texts is sent on.
ROWS, BYTES = 5000, 16 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the root's path in it: a local path, or a URI of a scheme that pyarrow knows."""
    if ":/" not in root:
        return fs.LocalFileSystem(), os.path.abspath(root)
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/") or "/"


def ending(name: str) -> str:
    """The suffix of a file name in lower case, without its dot; empty where there is none."""
    stem, dot, end = name.rpartition(".")
    return end.lower() if dot and stem else ""


class Subtrees(InputPartition):
    """Directories, each with all below it (deep) or with its own files only."""

    def __init__(self, at: list[tuple[str, bool]]):
        super().__init__(None)
        self.at = at


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.skipped = frozenset(json.loads(options.get("skipped", "[]")))
        self.spread = int(options.get("spread", SPREAD))
        #: Each is a list of beginnings, one of which a path must have; suffixes likewise.
        self.begins: list[tuple[str, ...]] = [tuple(b)] if (b := json.loads(options.get("below", "[]"))) else []
        self.suffixes: list[frozenset[str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Suffixes are answered here; beginnings of paths leave out subtrees and are looked at again."""
        for f in filters:
            column = f.attribute if isinstance(f, (EqualTo, In, StringStartsWith)) else None
            if column == ("suffix",) and isinstance(f, (EqualTo, In)):
                self.suffixes.append(frozenset(f.value if isinstance(f, In) else [f.value]))
                continue
            if column == ("path",):
                self.begins.append(tuple(x for x in f.value if x is not None) if isinstance(f, In) else (f.value,))
            yield f

    def _may_hold(self, directory: str) -> bool:
        """Whether a path below a directory (relative, with a slash at its end) can have the wanted beginnings."""
        return all(any(directory.startswith(b) or b.startswith(directory) for b in some) for some in self.begins)

    def _listed(self, store: fs.FileSystem, base: str, directory: str) -> tuple[list[fs.FileInfo], list[str]]:
        """Files, and the directories to go down to, of one directory. Links to directories are not followed; a directory that
        must not be read has nothing."""
        try:
            found = store.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/") or "/"))
        except PermissionError:
            return [], []
        local = isinstance(store, fs.LocalFileSystem)
        down = [f"{directory}{x.base_name}/" for x in found if x.type == fs.FileType.Directory and x.base_name not in self.skipped and not (local and os.path.islink(x.path))]
        return [x for x in found if x.type == fs.FileType.File], sorted(d for d in down if self._may_hold(d))

    def partitions(self) -> list[InputPartition]:
        store, base = opened(self.root)
        if store.get_file_info(base).type == fs.FileType.File:
            return [Subtrees([("", False)])]
        todo, own = deque([""]), []
        while todo and len(todo) < self.spread and len(own) < self.spread:
            own.append(todo.popleft())
            todo.extend(self._listed(store, base, own[-1])[1])
        work = [(d, False) for d in own] + [(d, True) for d in todo]
        n = min(self.spread, len(work))
        return [Subtrees(work[k::n]) for k in range(n)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        store, base = opened(self.root)
        one = store.get_file_info(base)
        rows: list[tuple] = []
        for info, path in [(one, one.base_name)] if one.type == fs.FileType.File else self._walk(store, base, partition.at):
            end = ending(info.base_name)
            if all(end in s for s in self.suffixes) and all(path.startswith(b) for b in self.begins):
                rows.append((path, end, info.size, info.mtime))
            if len(rows) == ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def _walk(self, store: fs.FileSystem, base: str, at: list[tuple[str, bool]]) -> Iterator[tuple[fs.FileInfo, str]]:
        todo = list(reversed(at))
        while todo:
            directory, deep = todo.pop()
            files, down = self._listed(store, base, directory)
            yield from ((x, directory + x.base_name) for x in files)
            if deep:
                todo.extend((d, True) for d in reversed(down))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class TreeSource(DataSource):
    """format("file_tree"): path (relative), suffix, size_bytes, last_modified of the files below a root (option path).

    Options: skipped (JSON list of names of directories to leave out), below (JSON list of beginnings of paths), spread.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, suffix string, size_bytes bigint, last_modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it (spark.sql.python.filterPushdown.enabled)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def listing(spark: SparkSession, root: str, skipped: Sequence[str] = (), below: Sequence[str] = ()) -> DataFrame:
    """path (relative to root), suffix, size_bytes, last_modified of all files below root, or of root itself if it is a file.

    Names with a dot or an underscore in front count like others. Filters by suffix or by the beginning of the path reach
    the listing, so that subtrees outside are not looked at. A missing root raises FileNotFoundError.
    """
    store, path = opened(root)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    register(spark)
    return spark.read.format(FORMAT).option("path", root).option("skipped", json.dumps(list(skipped))).option("below", json.dumps(list(below))).load()


def with_texts(files: DataFrame, root: str, parts: int | None = None) -> DataFrame:
    """files (a listing of root) with text: their contents as UTF-8, without bytes that are none.

    Rows are dealt to tasks by a hash of the path, so that a subtree with most of the files is read by all. A file that has
    gone since it was listed is left out.
    """
    spark = files.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        alone = store.get_file_info(base).type == fs.FileType.File
        for b in batches:
            kept, texts, size = [], [], 0
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with store.open_input_stream(base if alone else f"{base}/{path}") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                kept.append(i)
                texts.append(data.decode("utf-8", "ignore"))
                size += len(data)
                if size >= BYTES:
                    yield added(b, kept, texts)
                    kept, texts, size = [], [], 0
            if kept:
                yield added(b, kept, texts)

    return files.repartition(parts, "path").mapInArrow(read, files.schema.add("text", "string"))


def added(b: pa.RecordBatch, kept: list[int], texts: list[str]) -> pa.RecordBatch:
    rows = b.take(pa.array(kept, pa.int32()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])
