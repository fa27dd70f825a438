"""New folders for what a query writes and reads back; files by the paths that Spark gives."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import quote

import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        given = f"file://{tempfile.gettempdir()}/checkpoints/tandemlake-{context.applicationId}"
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Narrow rows, computed once and kept as Parquet where any executor can read them."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it (unescaped), and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pfs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    host, _, name = rest.partition("/")
    return pfs.FileSystem.from_uri(f"{scheme}://{host}/{quote(name)}")
