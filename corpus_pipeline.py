"""The corpus pipeline: its stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage takes all rows that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tandemlake.llm import decontam, dedup, packing, quality, simhash
from tandemlake.llm.common import table, written


def stored(docs: DataFrame) -> bool:
    """Whether docs is a scan of Parquet files, with filters and chosen columns at most, as every stage gets it from the one before.

    Of such a table no two rows have one place in a file. A table that was exploded, joined, united or sampled may repeat
    or choose rows anew, though it still knows where they come from.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        return bool(docs.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier, fitted on the labels of this folder, rejects.

    Null and empty texts are scored as an empty passage; repeated rows are judged each; no rows, no rows.
    """
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id (null the least), of several the last in place."""
    return dedup.without_copies(docs, stored(docs))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id (null the largest), of several the least text hash.

    Texts without words are one group, as null texts are.
    """
    return simhash.representatives(docs, stored(docs))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item. Null and empty texts hold none; an empty benchmark leaves all."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"), stored=stored(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences; a null or empty text is its separator alone, no rows give no records."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("quality classifier", good), ("exact dedup", distinct), ("near dedup", unlike), ("decontamination", unleaked), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
