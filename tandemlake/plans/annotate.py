"""From sequences to named, refined repeat arrays, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import kmers, slices
from ..operators import ani, boundaries, classify, intervals, periodicity, spans
from ..functions.names import region as parsed_region
from ..sources.indexed import Indexed, stored
from ..sources.scratch import cut
from .params import Params


def raw_spans(seqs: DataFrame | Indexed, p: Params) -> DataFrame:
    """seq_id, start, end: runs of similar windows, freed of conflicts within a band and between bands."""
    seqs = seqs if isinstance(seqs, Indexed) else stored(seqs)
    cells = ani.indexed_cells(seqs, p, p.identity)
    found = spans.diagonal_spans(cells, p.window, p.band, p.tolerance)
    found = intervals.grouped(cut(found), ["seq_id"], 4 * p.window)  # further than any of the rules reaches
    clear = intervals.without_conflicts(found, ["seq_id", "band"], p.window, ("first_row",))
    once = intervals.without_repeats(clear.withColumnRenamed("band", "_band"), ["seq_id"], ("_band",))
    whole = intervals.stitched(once, ["seq_id"], p.band, p.window)
    sizes = seqs.records().select("seq_id", F.col("seq_len").alias("n"))
    return whole.join(sizes, "seq_id").select("seq_id", "start", F.least("end", "n").alias("end")).where("start < end")


def shifted(found: DataFrame) -> DataFrame:
    """Coordinates of sequences without a range in their name, one less each, not below 0."""
    plain = parsed_region(F.col("seq_id").cast("string")).isNull()
    less = lambda c: F.greatest(F.lit(0), F.col(c) - F.when(plain, 1).otherwise(0)).cast("bigint").alias(c)
    return found.select("seq_id", less("start"), less("end"))


def named(found: DataFrame, seqs: DataFrame, db: DataFrame, p: Params) -> DataFrame:
    """found with the name of the class that holds most of each interval's k-mers."""
    keys = ["seq_id", "start", "end"]
    parts = slices(found.select(*keys), seqs, p.k, keys)
    queries = kmers(parts, p.k, distinct=True)
    queries = (queries if p.compat else queries.where("kmer <> 0")).select(F.col("seq_id").alias("query_id"), "kmer")
    top = classify.best(classify.overlaps(queries, db), p.threshold).select("query_id.*", "name")
    return found.join(top, keys, "left").withColumn("name", F.coalesce("name", F.lit(classify.UNKNOWN)))


def annotate(seqs: DataFrame | Indexed, p: Params | None = None, db: DataFrame | None = None, refine: bool = True) -> DataFrame:
    """seq_id, start, end, name (null without a database), refined, for indexed sequences, or a table of seq_id and seq.

    A table is read once, and its bases kept by index (see stored). They are then read once as a whole, for the windows; what
    spans need for their ends and names is read by its bytes. A database (class, kmer[, k]) with another k than the
    parameters' raises.
    """
    p = p or Params()
    if db is not None and "k" in db.columns and (other := sorted(r.k for r in classify.other_sizes(db, p.k).select("k").distinct().collect())):
        raise ValueError(f"the database has k-mers of {other} bases, not {p.k}")
    seqs = seqs if isinstance(seqs, Indexed) else stored(seqs)
    found = cut(raw_spans(seqs, p))  # few rows, that each of the next steps begins with
    if p.compat:
        found = shifted(found)
    if not refine:
        found = found.withColumn("refined", F.lit(False))
    elif p.compat:
        near = intervals.border_flags(found, ["seq_id"], p.band, p.window).select("seq_id", F.col("start").alias("raw_start"), F.col("end").alias("raw_end"), (F.col("at_border") | F.col("adjacent")).alias("near"))
        found = boundaries.refined(found, seqs, p.window, p.k, True).join(near, ["seq_id", "raw_start", "raw_end"]).where("refined or not near")
        end = lambda c, x: F.when(F.col("refined"), F.col(c)).otherwise(F.lit(x).cast("bigint")).alias(c)
        found = found.select("seq_id", end("start", 0), end("end", 1), "refined")
    else:
        found = boundaries.refined(found, seqs, p.window, p.k)
    found = found.select("seq_id", "start", "end", "refined")
    return named(cut(found), seqs, db, p) if db is not None else found.withColumn("name", F.lit(None).cast("string"))


def histograms(found: DataFrame, seqs: DataFrame, k: int, most: int = 10) -> DataFrame:
    """seq_id, start, end, rank, distance, cnt: each interval's `most` commonest distances between equal k-mers."""
    keys = ["seq_id", "start", "end"]
    parts = slices(found.select(*keys).distinct(), seqs, k, keys)
    top = periodicity.most_common(periodicity.histogram(kmers(parts, k).where("kmer <> 0")), most)
    return top.select("seq_id.*", "rank", "distance", "cnt")


def periods(found: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """seq_id, start, end, period: each interval's commonest distance between equal k-mers."""
    return histograms(found, seqs, k, 1).select("seq_id", "start", "end", F.col("distance").alias("period"))
