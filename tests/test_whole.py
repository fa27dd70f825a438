"""Sequences worked on whole give what the joins give, and shuffle their bases alone."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tandemlake.functions import kmers as K
from tandemlake.operators import ani, boundaries, classify, whole
from tandemlake.plans.params import Params
from tandemlake.sources.indexed import stored

from .conftest import rows

SF = "/root/testdata/sf0.01"
P = Params(k=5, window=10, band=60)
SHARES = pytest.mark.parametrize("share", [whole.LONG, 150])  # 150: sequences of more bases are long ones


@pytest.fixture(scope="module")
def seqs(spark):
    """Random and repeated bases; ids with two rows, no id, no bases, and fewer than a k-mer's."""
    r = random.Random(4)
    bases = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    found = [(i, bases(n)) for i, n in enumerate((60, 61, 119, 400, 149, 151, 700))] + [(20, "ACGGT" * 70), (21, "A" * 333), (22, bases(40) * 12)]
    found += [(3, bases(90)), (30, bases(80)), (30, bases(200)), (31, bases(30) + "N" + bases(70)), (40, ""), (41, "ACG"), (42, None)]
    return spark.createDataFrame(found, "seq_id bigint, seq string").repartition(3).cache()


def shuffled(spark, name: str) -> float:
    """Bytes that a query shuffles, as a part of the documents' file."""
    import os

    context = spark.sparkContext._jsc.sc()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    before = stages()
    entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    return sum(n for s, n in stages().items() if s not in before) / os.path.getsize(f"{SF}/documents.parquet")


def score(df):
    return rows(df.selectExpr("seq_id", "band", "i", "j", "round(score, 6)"))


def sets(seqs):
    return ani.window_sets(K.kmers(seqs, P.k, sketched=True).where("seq_id is not null"), P)


QUERIES = ["ani_cross_band", "ani_matrix", "kmer_extract_forward", "chunk_shared_bars", "chunk_shared_counts", "last_chunk_hit", "set_intersection_count", "canonical_kmer", "classify_best", "ani_matrix_dense", "hopping_window_sets", "classify_topk", "refined_spans", "span_order", "last_matching_index", "ambiguous_kmer_filter", "diagonal_attached_cells"]


@SHARES
def test_cross_band(spark, seqs, share):
    want = score(ani.cross_band(*sets(seqs), P.k))
    assert score(whole.cross_band(seqs, P, share)) == want != []


@SHARES
def test_cells(spark, seqs, share):
    want = score(ani.cells(*sets(seqs), P.k))
    assert score(whole.cells(seqs, P, share=share)) == want != []
    assert score(whole.cells(seqs, P, 80.0, share)) == [x for x in want if x[-1] >= 80] != want


def test_a_band_of_many_pairs_is_multiplied(monkeypatch):
    """Also beside bands that aren't."""
    r = random.Random(5)
    sequences = [[b"ACGGTCATTA" * 30], [bytes(r.choices(b"ACGT", k=500))], [b"AC" * 100, b"ACGGTCATTA" * 9]]
    held = []
    for most in (1 << 20, 40, 0):
        monkeypatch.setattr(whole, "PAIRS", most) if most else monkeypatch.setattr(ani, "_product", None)
        w = whole.Windows(*whole.hashed(sequences, P.k, True), P, len(sequences))
        if most:
            held.append([sorted(tuple(map(int, x)) for part in w.shared(step) for x in zip(*part, strict=True)) for step in (0, -1, 1)])
        else:
            with pytest.raises(TypeError):  # it was multiplied
                list(w.shared())
    assert held[0] == held[1] and all(held[0])


@SHARES
def test_words(spark, seqs, share):
    for k in (3, 12, 33):  # numbers of 32 bits and fewer, and strings
        words = K.forward_kmers(seqs.where("seq is not null").select("seq_id", "seq"), k)
        counts = lambda c: [F.countDistinct(c).alias("n_distinct"), F.min(c).alias("least"), F.max(c).alias("greatest")]
        want = rows(words.groupBy("seq_id").agg(F.count("*").alias("n"), *counts("kmer")))
        assert rows(whole.word_counts(seqs, k, share=share)) == want != []
        both = words.withColumn("kmer", F.least("kmer", K.reverse_complement(F.col("kmer"))))
        assert rows(whole.word_counts(seqs, k, True, share).drop("n")) == rows(both.groupBy("seq_id").agg(*counts("kmer")))


def test_words_of_any_letters(spark):
    text = spark.createDataFrame([(None, "the quick brown Fox jumps over the lazy dog. " * 3), (1, "aß\0\0\0\0"), (1, "zz")], "seq_id bigint, seq string")
    words = K.forward_kmers(text, 3)
    want = rows(words.groupBy("seq_id").agg(F.count("*"), F.countDistinct("kmer"), F.min("kmer"), F.max("kmer")))
    for share in (whole.LONG, 20):
        assert rows(whole.word_counts(text, 3, share=share)) == want


def middle(k):
    """Each sequence's k-mers, with what its middle third holds."""
    n = k.groupBy("seq_id").agg((F.max("pos") + 1).alias("n"))
    return k.join(n, "seq_id").where("pos >= n div 3 and pos < 2 * n div 3 and kmer <> 0").select("seq_id", "kmer").distinct()


@SHARES
def test_chunks_of_the_core(spark, seqs, share):
    k = K.kmers(seqs, 5)
    want = rows(boundaries.shared_counts(k, middle(k), 20))
    assert rows(whole.core_chunks(seqs, 5, 20, share)) == want != []


@SHARES
def test_intersections(spark, seqs, share):
    want = rows(ani.intersections(*sets(seqs)).select("seq_id", "band", "i", "j", "c"))
    assert rows(whole.intersections(seqs, P, share)) == want != []


@SHARES
def test_classes(spark, seqs, share):
    """The database looked up, and one too large for it joined."""
    named = seqs.where("seq_id is not null")
    some = K.kmers(named, 5, distinct=True).where("kmer <> 0 and seq_id in (1, 3, 5, 20, 21)")
    db = some.select(F.concat(F.lit("c"), F.col("seq_id")).alias("class"), "kmer").unionByName(spark.createDataFrame([("a", 1), ("z", 1), ("b", 2)], "class string, kmer int"))
    queries = K.kmers(named, 5, distinct=True).where("kmer <> 0").select(F.col("seq_id").alias("query_id"), "kmer")
    view = lambda df: rows(df.select("query_id", "class", "overlap", F.round("pct", 6), "rank"))
    want = view(classify.overlaps(queries, db))
    assert any(x[1] is None for x in want) or len(want) > 20
    for known in (whole.KNOWN, 3):
        assert view(whole.ranked(named, db, 5, share=share, known=known)) == want
        for most in (1, 4):
            assert view(whole.ranked(named, db, 5, most, share, known)) == view(classify.top(queries, db, most))


def test_classes_of_sequences_without_a_name(spark):
    """They share nothing, as in SQL, where null equals nothing; an empty database gives no class."""
    seqs = spark.createDataFrame([(None, "ACGTTGCA"), (1, "ACGTTGCA"), (2, "AAAAAAAA")], "seq_id bigint, seq string")
    db = K.kmers(seqs.where("seq_id = 1"), 5).where("kmer <> 0").select(F.lit("x").alias("class"), "kmer")
    assert [(r.query_id, r["class"], r.overlap > 0) for r in whole.ranked(seqs, db, 5, 2).orderBy("query_id").collect()] == [(None, "x", False), (1, "x", True), (2, "x", False)]
    assert [(r.query_id, r["class"], r.overlap) for r in whole.ranked(seqs, db.limit(0), 5).orderBy("query_id").collect()] == [(None, None, 0), (1, None, 0), (2, None, 0)]


@SHARES
@pytest.mark.parametrize("wide", [False, True])
def test_window_sums(spark, seqs, share, wide):
    want = sets(seqs)[wide].groupBy("seq_id", "band", "win").agg(F.count("*"), F.sum("kmer"))
    assert rows(whole.window_sums(seqs, P, wide, share)) == rows(want) != []


@pytest.mark.parametrize("compat", [False, True])
def test_refined_rows_equal_refined_pieces(spark, compat):
    r = random.Random(8)
    repeat = lambda n: "".join(r.choice("ACGT") if r.random() < 0.03 else c for c in "ACCTGATTGCAGGTCATTGAC" * n)
    noise = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    seqs = spark.createDataFrame([(str(i), noise(a) + repeat(n) + noise(b)) for i, (a, n, b) in enumerate([(900, 120, 800), (0, 200, 500), (700, 90, 0), (300, 30, 300), (50, 2, 50)])] + [("none", None), ("empty", "")], "seq_id string, seq string")
    spans = [("0", 800, 3500), ("0", 900, 3420), ("0", 800, 3500), ("1", 0, 4000), ("2", 600, 2600), ("3", 250, 900), ("4", 40, 90), ("4", 10, 12), ("none", 5, 900), ("empty", 0, 400), ("away", 1, 500), (None, 0, 900)]
    spans = spark.createDataFrame(spans, "seq_id string, start bigint, end bigint")
    want = rows(boundaries.refined(spans, stored(seqs, 512), 200, 11, compat).distinct())
    got = boundaries.refined(spans, seqs, 200, 11, compat)
    assert rows(got.distinct()) == want and any(x[-1] for x in want) and not all(x[-1] for x in want)
    assert got.count() == spans.count()


@SHARES
def test_last_of_the_core(spark, seqs, share):
    k = K.kmers(seqs, 5)
    n = k.groupBy("seq_id").agg(F.count("*").alias("n"))
    found = k.where("pos < 50").join(middle(k), ["seq_id", "kmer"], "left_semi").groupBy("seq_id").agg(F.max("pos").alias("pos"))
    want = n.join(found, "seq_id", "left").select("seq_id", F.when(F.col("n") < 50, 0).otherwise(F.coalesce("pos", F.lit(0))))
    assert rows(whole.last_in_core(seqs, 5, 50, share)) == rows(want)


@SHARES
def test_hashes(spark, seqs, share):
    k = K.kmers(seqs, 5)
    want = k.groupBy("seq_id").agg(F.count("*"), F.count_if(F.col("kmer") == 0), F.countDistinct(F.when(F.col("kmer") != 0, F.col("kmer"))))
    got = rows(whole.hash_counts(seqs, 5, share))
    assert got == rows(want) and any(x[2] for x in got)


@pytest.mark.parametrize("name", QUERIES)
def test_bases_alone_are_shuffled(spark, name):
    """A byte a base and less; k-mers took 4 to 34 times the input."""
    assert 0 < shuffled(spark, name) < 2
