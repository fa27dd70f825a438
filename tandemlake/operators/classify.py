"""Naming regions by the k-mers they share with classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def _counted(queries: DataFrame, db: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, n (distinct k-mers) of every query; query_id, class, overlap of those that share some."""
    q, d = queries.select("query_id", "kmer").distinct(), db.select("class", "kmer").distinct()
    return q.groupBy("query_id").agg(F.count("*").alias("n")), q.join(d, "kmer").groupBy("query_id", "class").agg(F.count("*").alias("overlap"))


def overlaps(queries: DataFrame, db: DataFrame) -> DataFrame:
    """query_id, class, overlap, pct, rank for queries(query_id, kmer) and db(class, kmer): the classes that share k-mers with a query.

    Ties rank by class name. A query that shares none has one row, without a class; top() names classes that share none.
    """
    n, shared = _counted(queries, db)
    return _ranked(n.join(shared, "query_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("bigint")))


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "class")
    return rows.select("query_id", "class", "overlap", (F.col("overlap") * 100.0 / F.col("n").cast("double")).alias("pct"), F.row_number().over(w).alias("rank"))


def top(queries: DataFrame, db: DataFrame, most: int) -> DataFrame:
    """Every query's first `most` classes, as overlaps() ranks them; where fewer share k-mers, others follow by name with 0.

    Those others are among the first 2 x most names, so a query meets no more classes than that.
    """
    n, shared = _counted(queries, db)
    first = db.select("class").distinct().orderBy("class").limit(2 * most)
    spare = n.select("query_id").join(F.broadcast(first))  # 2 x most rows
    filled = shared.unionByName(spare.withColumn("overlap", F.lit(0).cast("bigint"))).groupBy("query_id", "class").agg(F.max("overlap").alias("overlap"))
    return _ranked(filled.join(n, "query_id")).where(F.col("rank") <= most)


def other_sizes(db: DataFrame, k: int) -> DataFrame:
    """class, k of a database's k-mers that aren't k bases long."""
    return db.where(F.col("k") != k).select("class", "k").distinct()


def best(ranked: DataFrame, threshold: float = 25.0, least: int = 1) -> DataFrame:
    """query_id, name, overlap, pct: the first class if it has at least `least` k-mers and more than `threshold` percent."""
    sure = (F.col("overlap") >= least) & (F.col("pct") > threshold)
    return ranked.where("rank = 1").select("query_id", F.when(sure, F.col("class")).otherwise(UNKNOWN).alias("name"), "overlap", "pct")
