"""Runs along the diagonal of a score matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["seq_id", "band"]


def mirrored(cells: DataFrame) -> DataFrame:
    """Both triangles of a matrix given by its upper one, as row i, other j, side and distance from the diagonal."""
    side = lambda i, j, name: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(name).alias("side"))
    both = cells.select(*GROUP, (F.col("j") - F.col("i")).alias("dist"), F.explode(F.array(side("i", "j", "right"), side("j", "i", "left"))).alias("x"))
    return both.select(*GROUP, "x.i", "x.j", "x.side", "dist")


def reached(cells: DataFrame, tolerance: int) -> DataFrame:
    """The mirrored cells that each row reaches from the diagonal before `tolerance` empty ones in a row."""
    w = Window.partitionBy(*GROUP, "i", "side").orderBy("dist")
    gap = mirrored(cells).withColumn("gap", (F.col("dist") - F.lag("dist", 1, 0).over(w) > tolerance).cast("int"))
    return gap.withColumn("gaps", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("gaps = 0").drop("gap", "gaps")


def diagonal_spans(cells: DataFrame, window: int, band: int, tolerance: int = 2, support: int = 3) -> DataFrame:
    """seq_id, band, start, end, cnt, first_row: spans of bases that at least `support` rows reach alike."""
    rows = reached(cells, tolerance).groupBy(*GROUP, "i").agg(F.least(F.min("j"), F.col("i")).alias("a"), F.greatest(F.max("j"), F.col("i")).alias("z"))
    spans = rows.groupBy(*GROUP, "a", "z").agg(F.count("*").alias("cnt"), F.min("i").alias("first_row")).where(F.col("cnt") >= support)
    base = F.col("band") * F.lit(band).cast("bigint")
    return spans.select(*GROUP, (base + F.col("a") * window).alias("start"), (base + (F.col("z") + 1) * window).alias("end"), "cnt", "first_row")


def attached_cells(cells: DataFrame) -> DataFrame:
    """The cells (i < j) joined to the diagonal by unbroken runs along their row and their column."""
    w = Window.partitionBy(*GROUP, "i", "side").orderBy("dist")
    runs = mirrored(cells).withColumn("n", F.row_number().over(w)).where("n = dist")
    row = runs.where("side = 'right'").select(*GROUP, "i", "j")
    col = runs.where("side = 'left'").select(*GROUP, F.col("j").alias("i"), F.col("i").alias("j"))
    return row.join(col, [*GROUP, "i", "j"], "left_semi")


def off_diagonal_spans(cells: DataFrame, window: int, band: int) -> DataFrame:
    """seq_id, band, row_start, start, end, cnt: in bases, each row's unbroken runs of cells that aren't joined to the diagonal."""
    w = Window.partitionBy(*GROUP, "i").orderBy("j")
    runs = detached_cells(cells).withColumn("run", F.col("j") - F.row_number().over(w))
    base = F.col("band") * F.lit(band).cast("bigint")
    got = runs.groupBy(*GROUP, "i", "run").agg(F.min("j").alias("a"), F.max("j").alias("z"), F.count("*").alias("cnt"))
    return got.select(*GROUP, (base + F.col("i") * window).alias("row_start"), (base + F.col("a") * window).alias("start"), (base + (F.col("z") + 1) * window).alias("end"), "cnt")


def detached_cells(cells: DataFrame) -> DataFrame:
    """The other cells."""
    return cells.select(*GROUP, "i", "j").join(attached_cells(cells), [*GROUP, "i", "j"], "left_anti")
