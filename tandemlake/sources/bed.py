"""BED tables, and the other interval formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import region
from .folder import safe, write_files

# The standard columns of a BED line, those that are numbers, and an annotation's columns.
COLUMNS = ["chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]
NUMBERS = {"start", "end", "thickStart", "thickEnd"}
ANNOTATION = ["#chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb"]
FORMATS = ("bed", "gtf", "gff", "csv", "tsv", "json")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """A file's lines but track, browser, comment and blank ones. The first line's width is the table's: longer lines are cut to it,
    shorter ones raise; columns beyond the standard twelve are extra_0, extra_1 and so on. An empty file gives no rows and no columns."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(track|browser|#)|^\s*$")).select(F.split(F.trim("value"), "\t").alias("v"))
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "chrom string, start bigint, end bigint").select()
    width = len(first.v)
    named = [COLUMNS[i] if i < len(COLUMNS) else f"extra_{i - len(COLUMNS)}" for i in range(width)]
    checked = F.when(F.size("v") < width, F.raise_error(F.lit(f"a BED line has fewer than {width} columns"))).otherwise(F.col("v"))
    return lines.select(checked.alias("v")).select(*[F.col("v")[i].cast("bigint" if c in NUMBERS else "string").alias(c) for i, c in enumerate(named)])


def normalised(bed: DataFrame) -> DataFrame:
    """chrom, start, end, name; a table without names is named by chrom."""
    if missing := {"chrom", "start", "end"} - set(bed.columns):
        raise ValueError(f"a BED table lacks {sorted(missing)}")
    return bed.select("chrom", "start", "end", "name" if "name" in bed.columns else F.col("chrom").alias("name"))


def placed(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Intervals of records named chrom:lo-hi in the chrom's coordinates. compat ends them a base earlier."""
    lo = region(F.col("seq_id").cast("string"))["lo"]
    shift = F.when(lo.isNotNull(), lo - int(compat)).otherwise(0)
    return rows.withColumns({"start": F.col("start") + F.coalesce(lo, F.lit(0)), "end": F.col("end") + shift})


def annotation(rows: DataFrame, chrom: str = "seq_id", rgb: str = "0,0,0") -> DataFrame:
    """The nine columns of an annotation from seq_id, start, end and name."""
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col(chrom).cast("string").alias("#chrom"), "start", "end", name.alias("name"), F.lit(0).alias("score"), F.lit(".").alias("strand"), F.col("start").alias("thickStart"), F.col("end").alias("thickEnd"), F.lit(rgb).alias("itemRgb"))


def as_gtf(table: DataFrame) -> DataFrame:
    c = F.col
    return table.select(c("#chrom").alias("seqname"), F.lit("converted").alias("source"), F.lit("exon").alias("feature"), "start", "end", "score", "strand", F.lit(".").alias("frame"), F.concat(F.lit('gene_id "'), F.coalesce("name", F.lit("")), F.lit('";')).alias("attribute"))


def as_gff(table: DataFrame) -> DataFrame:
    c = F.col
    return table.select(c("#chrom").alias("seqid"), F.lit("converted").alias("source"), F.lit("region").alias("type"), "start", "end", "score", "strand", F.lit(".").alias("phase"), F.concat(F.lit("ID="), F.coalesce("name", F.lit(""))).alias("attributes"))


def write_table(table: DataFrame, path: str, fmt: str = "bed") -> None:
    """A folder of the annotation in a format. BED: a file {sequence}.bed each, with a header line; TSV and CSV have one too.

    Characters of a sequence's name that a file's can't have are percent-encoded, so that no two names share a file.
    """
    if fmt not in FORMATS:
        raise ValueError(f"{fmt!r} is none of {', '.join(FORMATS)}")
    w = lambda t: t.write.mode("overwrite").option("comment", "\x01")  # noqa: E731  else #chrom is quoted
    if fmt == "bed":
        _write_beds(table, path)
    elif fmt in ("gtf", "gff"):
        w(as_gtf(table) if fmt == "gtf" else as_gff(table)).csv(path, sep="\t", quote="")
    elif fmt == "json":
        w(table).json(path)
    else:
        w(table).csv(path, sep="\t" if fmt == "tsv" else ",", header=True)


def file_name(seq_id: str | None) -> str:
    return safe(seq_id) + ".bed"


def _write_beds(table: DataFrame, path: str) -> None:
    """A sequence's rows are in one task, in order. Files of an earlier run go; a run that fails changes nothing."""

    def contents(batches):
        now, begun = None, False
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ANNOTATION), strict=True):
                line = "\t".join("." if x is None else str(x) for x in row) + "\n"
                if not begun or row[0] != now:
                    now, begun, line = row[0], True, "\t".join(ANNOTATION) + "\n" + line
                yield file_name(now), line.encode()

    write_files(table.select(*[F.col(f"`{c}`") for c in ANNOTATION]), ["#chrom"], ["start", "end"], contents, path, ".bed")
