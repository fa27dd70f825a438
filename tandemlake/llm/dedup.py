"""Exact dedup by progressive refinement.

Rows are grouped by length; those that share one, by a hash of the text's first characters too; and only rows whose
group still has two members have their whole text read on and hashed. Which lengths are shared is a small table (a row a distinct
length). Which groups survive the second step is handed to the last scan as a bitmap of fixed size, so no text is ever
shuffled; two keys that share a bit cost a hash that wasn't needed, nothing else. Groups of equal full hashes are the
result.

Texts are equal when they are identical after lower-casing A-Z. Null counts as the empty text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, UPPER, cut, empty_if_null, ids_and_text, map_batches, utf8, with_row, without_rows

PREFIX, BITS = 64, 1 << 24
FEW = 1 << 20  # distinct lengths that are broadcast


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def survivors(docs: DataFrame, prefix: int, bits: int) -> np.ndarray:
    """One bit for each (length, prefix hash) that two rows share; `bits` / 64 rows at most reach the driver."""
    length = F.octet_length("text").alias("len")
    shared = cut(docs.select(length).groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"))
    shared = F.broadcast(shared) if shared.count() <= FEW else shared  # beyond that Spark sorts both sides
    keys = docs.select(length, F.substring("text", 1, prefix).alias("pre")).join(shared, "len", "left_semi").select("len", F.xxhash64(lowered(F.col("pre"))).alias("pre"))
    twice = keys.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1").select(F.pmod(F.xxhash64("len", "pre"), F.lit(bits)).alias("bit"))
    words = twice.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("b")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in words:
        out[r.word] = r.b
    return out


def hashes(docs: DataFrame, prefix: int = PREFIX, bits: int = BITS, all_rows: bool = False, row: str | None = None) -> DataFrame:
    """row, doc_id, survived, sha (binary; null for rows that didn't survive, unless all_rows).

    row (of type ROW) is docs' column of that name, or else a number of each row's own.
    """
    name = F.col(row) if row else F.struct(F.spark_partition_id().cast("string").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), empty_if_null("text"), name.alias("row"))
    bitmap = cut(rows.sparkSession.createDataFrame([(bytearray(survivors(ids_and_text(docs), prefix, bits).astype("<i8").tobytes()),)], "b binary")).scalar()
    bit = F.pmod(F.xxhash64(F.octet_length("text"), F.xxhash64(lowered(F.substring("text", 1, prefix)))), F.lit(bits))
    byte = F.conv(F.hex(F.substring(bitmap, (F.col("bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    keyed = rows.withColumn("bit", bit).withColumn("alive", byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0)
    if not all_rows:  # what doesn't survive isn't read further
        keyed = keyed.withColumn("text", F.when(F.col("alive"), F.col("text")).otherwise(""))

    def full(batches):
        for b in batches:
            alive = np.asarray(b.column("alive").to_numpy(zero_copy_only=False), bool)
            data, at = utf8(b.column("text"))
            raw, at = memoryview(data), at.tolist()
            sha = [hashlib.sha256(bytes(raw[x:y]).lower()).digest() if all_rows or a else None for x, y, a in zip(at, at[1:], alive.tolist(), strict=False)]  # bytes.lower() lowers A-Z only
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(alive), pa.array(sha, pa.binary())], ["row", "doc_id", "survived", "sha"])

    return cut(map_batches(keyed, full, f"row {ROW}, doc_id bigint, survived boolean, sha binary"))


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, bits: int = BITS, all_hashes: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, sha.

    Of equal texts the row with the largest doc_id stays; of several such rows, and of rows without any doc_id, one
    (so exactly one row of each group has kept = true). A null doc_id is smaller than any other and is keep_id only
    where the whole group has none. sha is null for texts that were told apart before their full hash was needed,
    unless all_hashes. Other columns are ignored. No rows give no rows.
    """
    return decided(hashes(docs, prefix, bits, all_hashes)).select("doc_id", "keep_id", "group_size", "kept", "sha")


def decided(h: DataFrame) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, sha of hashes' rows."""
    own = F.struct(F.col("doc_id"), F.col("row"))
    groups = h.where("survived").groupBy("sha").agg(F.max(own).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = cut(groups)  # so that the join stands on exchanges of its own, whose large partitions Spark splits
    found = h.where("survived").join(groups, "sha", "left")
    alone = h.where("not survived").withColumns({"best": F.lit(None).cast(f"struct<doc_id:bigint,row:{ROW}>"), "group_size": F.lit(None).cast("bigint")})
    return found.unionByName(alone).select(
        "row",
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "sha",
    )


def without_copies(docs: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts the row that exact_dedup keeps.

    Of rows with equal doc_id and text, whatever their other columns hold, the last in place stays. See with_row on
    `stored`. No rows give no rows.
    """
    docs, name = with_row(docs, stored)
    return without_rows(docs, name, decided(hashes(docs, row=name)).where("not kept").select("row.*"))
