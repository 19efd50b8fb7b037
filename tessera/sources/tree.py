"""File trees, snapshots and change lists."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ignored, language_of
from ..functions.text import lines
from .listing import listing, with_texts

SKIPPED = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".tox", "target", ".idea", ".vscode")


def scan(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, ignore: Sequence[str] = (), include_dirs: Sequence[str] = (), skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """path (relative), language, size_bytes, last_modified, line_count, text of the files below root (or root itself).

    Directories with an excluded name are left out of the listing, so that nothing in them is looked at; suffixes and
    included directories reach the listing, and only files that pass all rules are read.
    """
    d = listing(spark, root, skipped, [x.rstrip("/") + "/" for x in include_dirs])
    if extensions:
        d = d.where(F.col("suffix").isin([e.lstrip(".").lower() for e in extensions]))
    d = with_texts(d.where(~ignored(F.col("path"), ignore)).drop("suffix"), root)
    return d.withColumn("language", language_of(F.col("path"))).withColumn("line_count", F.size(lines(F.col("text"))).cast("long"))


def ignore_file(spark: SparkSession, path: str) -> list[str]:
    """Patterns of an ignore file (a short file of rules); a missing file has none."""
    if not os.path.exists(path):
        return []
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").collect()
    return [r.value for r in rows]


def hashes(files: DataFrame) -> DataFrame:
    """path, hash of content and modification time."""
    return files.select("path", F.sha2(F.concat("text", F.col("last_modified").cast("string")), 256).alias("hash"))


def git_changes(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    """path, status (changed, new, deleted) of a work tree against a commit; what git says against it raises RuntimeError."""
    rows = []
    for flag, status in (("M", "changed"), ("A", "new"), ("D", "deleted")):
        got = subprocess.run(["git", "-C", root, "diff", "--no-renames", "--name-only", f"--diff-filter={flag}", base], capture_output=True, text=True)
        if got.returncode:
            raise RuntimeError(got.stderr.strip() or "git failed")
        rows += [(p, status) for p in got.stdout.splitlines() if p]
    return spark.createDataFrame(rows, "path string, status string")


def split_by_existence(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(p, "changed" if os.path.exists(p) else "deleted") for p in paths], "path string, status string")
