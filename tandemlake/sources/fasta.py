"""FASTA records as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = 60
#: What divides records: a line that begins with this sign. Inside a line it is text.
SEPARATOR = "\n>"


def records(pieces: DataFrame) -> DataFrame:
    """pieces' columns, with value replaced by seq_id (the header up to its first blank) and seq: a row for each record of text read with SEPARATOR.

    A file's first record still has its sign. Line ends may have carriage returns. A record may be without bases; one
    without a header and bases, such as blank lines before the first record, isn't any.
    """
    text = F.regexp_replace("value", "^>", "")
    rows = pieces.withColumn("value", text).where(F.col("value").rlike(r"\S"))
    head = F.substring_index("value", "\n", 1)
    seq = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s", "")).otherwise("")
    return rows.select(*[c for c in rows.columns if c != "value"], F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), seq.alias("seq"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, seq_id, seq, seq_len of every record. Compressed files are read whole by a task.

    A record is one row, so it has to fit in one (2 GB); sources/indexed.py reads records of any length by their pieces. A
    compressed file that breaks off raises.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(paths)
    return records(raw.select(F.input_file_name().alias("file"), "value")).withColumn("seq_len", F.length("seq").cast("bigint"))


def catalogue(seqs: DataFrame) -> DataFrame:
    return seqs.select("file", "seq_id", "seq_len")


def names(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id").distinct()


def selected(seqs: DataFrame, ids: list[str]) -> DataFrame:
    """The records asked for by name or by chrom:lo-hi, in which case that part; the first file that has one gives it.

    Which record answers is decided on names alone; then the asked ids, few, are joined to the sequences.
    """
    asked = seqs.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(ids)], "asked string")
    group = lambda i: F.regexp_extract("asked", r"^(.*):(\d+)-(\d+)$", i)
    whole = asked.select("asked", F.col("asked").alias("seq_id"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), F.lit(0).alias("part"))
    part = asked.where(group(1) != "").select("asked", group(1).alias("seq_id"), group(2).cast("bigint").alias("lo"), group(3).cast("bigint").alias("hi"), F.lit(1).alias("part"))
    found = seqs.select("file", "seq_id").join(F.broadcast(whole.unionByName(part)), "seq_id")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("asked").orderBy("part", "file"))).where("_r = 1")
    best = seqs.join(F.broadcast(first.select("file", "seq_id", "asked", "lo", "hi")), ["file", "seq_id"])  # a row an asked id
    seq = F.when(F.col("lo").isNull(), F.col("seq")).otherwise(F.expr("cast(substring(cast(seq as binary), cast(lo as int) + 1, cast(hi - lo as int)) as string)"))
    return best.select("file", F.col("asked").alias("seq_id"), seq.alias("seq")).withColumn("seq_len", F.length("seq").cast("bigint"))


def region(seq, start, end, compat: bool = False):
    """Bases start to end (0-based, end exclusive) of a sequence column; null where start is beyond end. compat never reads base 0."""
    low = F.greatest(start, F.lit(int(compat)))
    return F.when(low <= end, F.substring(seq.cast("binary"), (low + 1).cast("int"), (end - low).cast("int")).cast("string"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    """One folder of FASTA text for each sequence, under path. Spark escapes what a folder's name can't hold, so no two names share one."""
    lines = F.regexp_replace("seq", f"(.{{{LINE}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), lines).alias("value"), F.col("seq_id").alias("record")).write.mode("overwrite").partitionBy("record").text(path)
