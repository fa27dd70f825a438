"""Distances between equal k-mers, which show a repeat's monomer length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import forward_kmers
from .lookups import region_slices


def distances(kmers: DataFrame) -> DataFrame:
    """seq_id, pos, distance to the k-mer's place before."""
    w = Window.partitionBy("seq_id", "kmer").orderBy("pos")
    return kmers.withColumn("distance", F.col("pos") - F.lag("pos").over(w)).where("distance is not null").select("seq_id", "pos", "distance")


def histogram(kmers: DataFrame) -> DataFrame:
    """seq_id, distance, cnt, first_pos."""
    return distances(kmers).groupBy("seq_id", "distance").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


def most_common(counted: DataFrame, n: int) -> DataFrame:
    """A sequence's n commonest distances, of equally common ones the first met first: seq_id, distance, cnt, rank."""
    w = Window.partitionBy("seq_id").orderBy(F.desc("cnt"), "first_pos")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("seq_id", "distance", "cnt", "rank")


def by_name(regions: DataFrame, seqs: DataFrame, k: int, most: int = 10, order: str = "file") -> DataFrame:
    """name (lower case), chrom, start, end, top: the `most` commonest distances (distance, cnt), in order, between equal k-mers of each region.

    k-mers are strings as they stand; a region's first is left out. Regions without a repeated k-mer have no row.
    """
    keys = ["name", "chrom", "start", "end"]
    rows = regions.select(F.lower("name").alias("name"), "chrom", "start", "end").distinct()
    words = forward_kmers(region_slices(rows, seqs, k, keys, order), k).where(F.col("pos") > F.greatest(F.col("seq_id.start"), F.lit(0)))
    top = most_common(histogram(words), most)
    return top.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "distance", "cnt"))), lambda x: F.struct(x["distance"].alias("distance"), x["cnt"].alias("cnt"))).alias("top")).select("seq_id.*", "top")
