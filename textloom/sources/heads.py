"""The first bytes of many files.

Files are listed by Spark without their contents. Files within the limit are read by Spark as they are; of larger ones a task opens
the file and reads the limit only, so a file of any size costs no more than the limit. Larger files need a file system that pyarrow can
open by URI (local, HDFS, S3, GCS); the others may lie wherever Spark can read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_head(uri: str, limit: int) -> bytes:
    """At most ``limit`` bytes from the start of a file; short reads go on."""
    from pyarrow import fs
    local = re.match("file:/+", uri)
    system, path = (fs.LocalFileSystem(), "/" + uri[local.end():]) if local else fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return f.read(limit)


def file_heads(spark: SparkSession, path: str, limit: int, glob: str = "*") -> DataFrame:
    """(path, length, head): every file under ``path``, its full length and at most its first ``limit`` bytes. Spark's listing
    leaves files of no bytes out; they have no row."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))
    small = files.where(F.col("length") <= limit).select("path", "length", F.col("content").alias("head"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, n in zip(batch["path"], batch["length"]):  # one file at a time: a batch of heads would be many megabytes
                yield pd.DataFrame({"path": [p], "length": [n], "head": [read_head(p, limit)]})

    large = files.where(F.col("length") > limit).select("path", "length").mapInPandas(heads, "path string, length long, head binary")
    return small.unionByName(large)
