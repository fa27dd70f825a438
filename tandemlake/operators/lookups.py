"""Joins of regions with sequences and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import kmers, slices


def missing_chroms(bed: DataFrame, names: DataFrame) -> DataFrame:
    """Chroms of a BED table that no sequence has."""
    return bed.select("chrom").distinct().join(names.select(F.col("seq_id").alias("chrom")), "chrom", "left_anti")


def first_source(regions: DataFrame, seqs: DataFrame, order: str) -> DataFrame:
    """Each region with the first of seqs' `order` values that has its chrom, and the chrom as seq_id. Sequences themselves aren't joined."""
    names = seqs if isinstance(seqs, DataFrame) else seqs.records()
    first = names.select("seq_id", order).groupBy("seq_id").agg(F.min(order).alias(order))
    return regions.join(first, regions["chrom"] == first["seq_id"])


def region_slices(regions: DataFrame, seqs: DataFrame, k: int, keys: list[str], order: str = "file") -> DataFrame:
    """Pieces of regions (keys, chrom, start, end) for hashing: seq_id (a struct of the keys), pos0, seq."""
    source = F.struct(order, "seq_id")
    placed = first_source(regions, seqs, order).select(*keys, source.alias("seq_id"), "start", "end")
    return slices(placed, seqs.select(source.alias("seq_id"), "seq") if isinstance(seqs, DataFrame) else seqs.keyed(source), k, keys)


def region_kmers(regions: DataFrame, seqs: DataFrame, k: int, order: str = "file", zeros: bool = False) -> DataFrame:
    """subtype (lower-case name), kmer: the distinct k-mers of all regions of a name. Case variants are one name; 0 is left out unless zeros."""
    parts = region_slices(regions.withColumn("subtype", F.lower("name")), seqs, k, ["subtype"], order)
    got = kmers(parts, k, distinct=True)
    return (got if zeros else got.where("kmer <> 0")).select("seq_id.subtype", "kmer").distinct()


def classed(subtypes: DataFrame, classes: DataFrame) -> DataFrame:
    """class, subtype, kmer: subtypes that a class map names, whatever their case."""
    return subtypes.join(classes.select("class", F.lower("subtype").alias("subtype")), "subtype").select("class", "subtype", "kmer")
