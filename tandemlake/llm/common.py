"""What the corpus operators share: table access, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        given = f"file://{tempfile.gettempdir()}/checkpoints/tandemlake-{context.applicationId}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Narrow rows, computed once and kept where any executor can read them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Wide rows, written once as Parquet in the shared folder and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(fs: pfs.FileSystem, mine: str, name: str) -> None:
    """Moves a whole file into place. Where a store doesn't replace files, one that another attempt put there stays: its bytes are the same."""
    try:
        fs.move(mine, name)
    except OSError:
        if fs.get_file_info(name).type != pfs.FileType.File:
            raise
        fs.delete_file(mine)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a Python worker's memory has a bound whatever the rows hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over df's batches. Columns may have dots and backquotes in their names, which mapInArrow itself can't resolve."""
    bounded_batches(df.sparkSession)
    names = df.columns
    if not any(c in name for name in names for c in ".`"):
        return df.mapInArrow(f, schema)
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lambda batches: f(b.rename_columns(names) for b in batches), schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and int64 row limits (rows + 1 of them); null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, limits, data = column.buffers()
    at = np.frombuffer(limits, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if limits and len(column) else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


ROW = "struct<file:string,at:bigint>"


def with_row(docs: DataFrame, stored: bool = False) -> tuple[DataFrame, str]:
    """docs with a column of type ROW that tells its rows apart, and that column's name.

    stored: docs is a table as read from Parquet files, whose rows are known by file and place in it. Any other table is
    written first, so that its rows are the same ones whenever they are read again.
    """
    name = fresh(docs, "_row")
    if stored:
        return docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), name
    row = F.struct(F.spark_partition_id().cast("string").alias("file"), F.monotonically_increasing_id().alias("at"))
    return written(docs.withColumn(name, row), "rows"), name


def without_rows(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """The rows of with_row's table whose row isn't in gone (file, at), and without that column.

    Neither texts nor a table of ids meet in one place: ids are written by file, and a task reads those of its own files.
    """
    folder = scratch(rows.sparkSession, "gone")
    path = lambda root, file: f"{root}/{hashlib.sha256(file.encode()).hexdigest()}"

    def put(batches):
        fs, root = pfs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, parts, attempt = None, [], TaskContext.get().taskAttemptId()

        def close():
            if now is not None:
                mine = f"{path(root, now)}.attempt-{attempt}"
                with fs.open_output_stream(mine) as f:
                    for p in parts:
                        f.write(p)
                settle(fs, mine, path(root, now))

        for b in batches:
            file, at = b.column("file").to_pylist(), np.asarray(b.column("at")).astype("<i8")
            cuts = [0, *(i for i in range(1, len(file)) if file[i] != file[i - 1]), len(file)]
            for x, z in zip(cuts, cuts[1:], strict=False):
                if x < z and file[x] != now:
                    close()
                    now, parts = file[x], []
                parts.append(at[x:z].tobytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["n"])

    cut(map_batches(gone.select("file", "at").repartition("file").sortWithinPartitions("file", "at"), put, "n bigint"))
    columns = [c for c in rows.columns if c != name]

    def keep(batches):
        fs, root = pfs.FileSystem.from_uri(folder)
        now, ids = None, np.zeros(0, np.int64)
        for b in batches:
            row = b.column(name)
            coded = row.field("file").dictionary_encode()
            code, at, stays = np.asarray(coded.indices), np.asarray(row.field("at")), np.ones(b.num_rows, bool)
            for k, file in enumerate(coded.dictionary.to_pylist()):
                if file != now:
                    now, ids = file, np.zeros(0, np.int64)
                    if fs.get_file_info(path(root, file)).type == pfs.FileType.File:
                        with fs.open_input_stream(path(root, file)) as f:
                            ids = np.frombuffer(f.read(), "<i8")
                mine = np.nonzero(code == k)[0]
                stays[mine] = ~np.isin(at[mine], ids)
            yield b.select(columns).filter(pa.array(stays))

    return map_batches(rows, keep, T.StructType([f for f in rows.schema.fields if f.name != name]))


def empty_if_null(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def ids_and_text(docs: DataFrame) -> DataFrame:
    """doc_id (bigint) and text (never null), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), empty_if_null("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
