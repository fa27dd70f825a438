"""How the sources of a language differ in their words, by relational steps alone.

Terms are what a split at everything else leaves, exploded and counted by language, source and term; a document's
distinct terms ride along in the same rows, so one aggregate, combined where the rows are made, gives both counts. A
language keeps the terms that enough of its documents hold. Its groups are crossed with that vocabulary, so that a term
a group lacks is a row with 0, and the dense rows are joined to themselves on language and term: sums of absolute
differences rank a group's other sources, differences from the language's own shares rank the terms it favours.

Crossing deals a language's terms out by a hash to which every group is repeated, so no language is one task. Sources
of a language meet once for each term and two of them: the result has a row for each two, so that is what it costs.
All shares are integers: divisions are of decimals, and exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, empty_if_null, fresh

#: Runs of letters: A-Z, a-z and whatever is beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What lies between them. A split there makes the same terms, without a match object for each.
BETWEEN = TERM.replace("^", "", 1)
#: Bytes of a text beyond which its terms are matched after all: slower, but a split needs more memory at once.
LONG = 4 << 20
LEAST, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it). Only A-Z are lower-cased."""
    name = fresh(docs, "_all")
    text = empty_if_null("text")
    low = F.translate(text, UPPER, LOWER)
    terms = F.when(F.octet_length(text) <= LONG, F.split(low, BETWEEN)).otherwise(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))
    rows = docs.select(empty_if_null("lang"), empty_if_null("source"), terms.alias(name))
    each = rows.select("lang", "source", F.size(name).alias("_n"), F.posexplode(F.concat(name, F.array_distinct(name))).alias("_at", "term")).where("term <> ''")  # a split's ends may be empty
    again = (F.col("_at") >= F.col("_n")).cast("bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - again).alias("n"), F.sum(again).alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * kept)), exact for counts of any size that a bigint holds."""
    return F.expr(f"1L + cast(cast({UNIT} as decimal(12,0)) * (cast({n} as decimal(20,0)) + {SMOOTH}) div (cast({total} as decimal(20,0)) + cast({SMOOTH} as decimal(2,0)) * {kept}) as bigint)")


def dense(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source) that occur, and lang, source, term, n, p, q for each group and kept term of its language.

    p is the group's share of the term and q the language's, both smoothed.
    """
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    held = term_counts(docs).withColumns({"all": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term)}).where(F.col("docs") >= least).drop("docs")
    held = cut(held)
    kept = held.groupBy("lang", "term").agg(F.max("all").alias("all"))
    groups = docs.select(empty_if_null("lang"), empty_if_null("source")).distinct()
    total = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count("*").alias("v"))
    sized = cut(groups.join(total, ["lang", "source"], "left").join(of_lang, "lang", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("bigint"))))
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = sized.where("v is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    crossed = kept.withColumn("salt", F.pmod(F.hash("term"), F.lit(salts))).join(spread, ["lang", "salt"])
    full = crossed.join(held.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return sized.select("lang", "source"), cut(full.select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), share("all", "lang_total", "v").alias("q")))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for documents (text, lang, source); null counts as '' in each of them.

    Part `pair`: every other source of the language, with the summed differences of the two shares over all kept terms
    (0 where none are kept). Part `term`: up to `top` kept terms that the group holds and has a larger share of than its
    language, with that difference. Ranks run from 1 by value, largest first, and by the item's UTF-8. Repeated rows are
    documents of their own; groups without any term take part; other columns are ignored; no rows give no rows; texts
    of any length are read whole.
    """
    groups, rows = dense(docs, least)
    key = ["lang", "source"]
    other = rows.select("lang", F.col("source").alias("item"), "term", F.col("p").alias("q2"))
    half = rows.select(*key, "term", "p").join(other, ["lang", "term"]).where("source < item").groupBy(*key, "item").agg(F.sum(F.abs(F.col("p") - F.col("q2"))).alias("value"))
    half = cut(half)
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # two groups are a row also where their language keeps no term
    met = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").join(both, [*key, "item"], "left")
    order = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    pairs = met.select(*key, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value")).withColumn("rank", F.row_number().over(order))
    above = rows.where("n > 0 and p > q").select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
