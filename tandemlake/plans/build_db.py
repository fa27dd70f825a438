"""A k-mer class database from regions and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookups


def build_db(regions: DataFrame, seqs: DataFrame, k: int, classes: DataFrame | None = None, order: str = "file", zeros: bool = False) -> DataFrame:
    """class, subtype, k, kmer. With a class map, its classes and the subtypes it names; without, each name is a class. zeros keeps the k-mer 0, as Params.compat does."""
    subtypes = lookups.region_kmers(regions, seqs, k, order, zeros)
    got = lookups.classed(subtypes, classes) if classes is not None else subtypes.select(F.col("subtype").alias("class"), "subtype", "kmer")
    return got.withColumn("k", F.lit(k)).select("class", "subtype", "k", "kmer")
