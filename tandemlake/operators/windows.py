"""Bands and windows over positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.params import Params


def banded(kmers: DataFrame, p: Params) -> DataFrame:
    """seq_id, band, local, kmer. The first `interval` positions of a band also end the band before it."""
    own = F.struct(F.expr(f"pos div {p.band}L").alias("band"), F.expr(f"pos % {p.band}L").alias("local"))
    carried = F.when((F.col("pos") >= p.band) & (F.expr(f"pos % {p.band}L") < p.interval), F.struct(F.expr(f"pos div {p.band}L - 1").alias("band"), F.expr(f"pos % {p.band}L + {p.band}L").alias("local")))
    return kmers.select("seq_id", "kmer", F.explode(F.array_compact(F.array(own, carried))).alias("at")).select("seq_id", F.col("at.band").alias("band"), F.col("at.local").alias("local"), "kmer")


def tumbling(banded_: DataFrame, p: Params) -> DataFrame:
    """seq_id, band, win, kmer: distinct k-mers of the plain windows [win * w, (win + 1) * w)."""
    return banded_.where(F.col("local") < p.band).select("seq_id", "band", F.expr(f"local div {p.window}L").cast("int").alias("win"), "kmer").distinct()


def hopping(banded_: DataFrame, p: Params) -> DataFrame:
    """seq_id, band, win, kmer: distinct k-mers of the windows that reach `interval` further on either side."""
    first = F.greatest(F.lit(0), F.floor((F.col("local") - p.interval) / p.window).cast("int"))
    last = F.least(F.lit(p.windows - 1), F.floor((F.col("local") + p.interval) / p.window).cast("int"))
    return banded_.select("seq_id", "band", "kmer", F.explode(F.sequence(first, last)).alias("win")).select("seq_id", "band", "win", "kmer").distinct()


def placed(wins: DataFrame, p: Params) -> DataFrame:
    """wins(band, win, ...) with the window's start and end in its sequence."""
    start = F.col("band") * p.band + F.col("win") * p.window
    return wins.withColumns({"start": start, "end": start + p.window})
