"""Annotation of FASTA files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.annotate import annotate
from ..plans.params import Params
from ..sources.bed import annotation
from ..sources.fasta import SEPARATOR, records


def annotate_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, p: Params | None = None, db: DataFrame | None = None) -> StreamingQuery:
    """Each micro-batch's records are annotated and written under out/batch=N, which a batch that runs again overwrites."""
    seqs = records(spark.readStream.option("lineSep", SEPARATOR).text(folder))

    def batch(df: DataFrame, number: int) -> None:
        annotation(annotate(df, p, db)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return seqs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
