"""Region names such as chr1:100-200."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a record name with one or more ranges.
NAMED = r"^([a-zA-Z0-9_]+)(?::(\d+-\d+))+"


def region(name: Column) -> Column:
    """struct(chrom, lo, hi) of a name with ranges, the last of which counts; null for any other name."""
    last = F.element_at(F.regexp_extract_all(name, F.lit(r"(\d+-\d+)"), 1), -1)
    bounds = F.split(last, "-")
    return F.when(name.rlike(NAMED), F.struct(F.regexp_extract(name, NAMED, 1).alias("chrom"), bounds[0].cast("bigint").alias("lo"), bounds[1].cast("bigint").alias("hi")))
