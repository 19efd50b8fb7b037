"""A landing folder as a stream of sources."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language_of


def watch(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file_id (path below root), language, text, seq (time of change), deleted of the files that arrive below root, as apply_changes() takes
    them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    d = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = re.sub("^file:/*", "/", root if ":/" in root else os.path.abspath(root)).rstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), r"^\Q" + base + r"\E/*", "")
    text = F.replace(F.decode("content", "UTF-8"), F.lit("�"), F.lit(""))
    return d.select(name.alias("file_id"), language_of(name).alias("language"), text.alias("text"), F.unix_millis("modificationTime").alias("seq"), F.lit(False).alias("deleted"))
