import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemlake.operators import ani, boundaries, classify, intervals, lookups, mask, periodicity, spans, windows
from tandemlake.plans.params import Params

from .conftest import rows


def test_windows(spark):
    p = Params(k=2, window=4, band=8)
    k = spark.createDataFrame([("s", i, i + 1) for i in range(20)], "seq_id string, pos bigint, kmer int")
    b = windows.banded(k, p)
    plain = {}
    for s, band, w, x in rows(windows.tumbling(b, p)):
        plain.setdefault((band, w), []).append(x - 1)
    assert plain[0, 0] == [0, 1, 2, 3] and plain[0, 1] == [4, 5, 6, 7] and sorted(plain[1, 0]) == [8, 9, 10, 11]
    wide = {}
    for s, band, w, x in rows(windows.hopping(b, p)):
        wide.setdefault((band, w), []).append(x - 1)
    assert sorted(wide[0, 0]) == list(range(6)) and sorted(wide[0, 1]) == list(range(2, 10))
    assert sorted(wide[1, 0]) == list(range(8, 14))  # no left overlap where a band begins


def frame(spark, sets):
    return spark.createDataFrame([("s", 0, w, x) for w, xs in sets.items() for x in xs], "seq_id string, band bigint, win int, kmer int")


def test_ani_golden(spark):
    plain, wide = frame(spark, {0: [1, 2, 3, 4], 1: [5, 6]}), frame(spark, {0: [1, 2, 3, 4, 5], 1: [4, 5, 6]})
    for got in (ani.cells(plain, wide, 2), ani.dense_cells(plain, wide, 2, 2)):
        assert [(r.i, r.j, round(r.score, 6)) for r in got.collect()] == [(0, 1, 70.710678)]


def test_dense_equals_join(spark):
    r = random.Random(1)
    plain = frame(spark, {w: r.sample(range(40), 9) for w in (0, 1, 2, 4, 6)})
    wide = frame(spark, {w: r.sample(range(40), 14) for w in range(7)})
    a = rows(ani.cells(plain, wide, 5).selectExpr("i", "j", "round(score, 6)"))
    assert a == rows(ani.dense_cells(plain, wide, 5, 7, columns=8).selectExpr("i", "j", "round(score, 6)")) and a


def test_band_cells_equal_the_join(spark):
    r = random.Random(2)
    p = Params(k=4, window=10, band=60)
    k = spark.createDataFrame([(s, i, r.choice((4, 8, 12, 16, 400 + i))) for s in "ab" for i in range(150)], "seq_id string, pos bigint, kmer int")
    plain, wide = ani.window_sets(k, p)
    view = lambda df: rows(df.selectExpr("seq_id", "band", "i", "j", "round(score, 6)"))
    want = view(ani.cells(plain, wide, 4))
    assert want and view(ani.band_cells(windows.banded(k, p), p)) == want == view(ani.dense_cells(plain, wide, 4, p.windows, columns=3))


def test_cross_band_needs_later_windows(spark):
    plain = spark.createDataFrame([("s", 0, 1, 7), ("s", 1, 0, 7), ("s", 1, 2, 9), ("s", 0, 0, 9)], "seq_id string, band bigint, win int, kmer int")
    assert [(r.band, r.i, r.j) for r in ani.cross_band(plain, plain, 3).collect()] == [(1, 0, 1)]


def test_indexed_cells_equal_band_cells(spark):
    from tandemlake.functions import kmers as K
    from tandemlake.sources.indexed import stored

    r = random.Random(12)
    repeat = lambda n: "".join(r.choice("ACGT") if r.random() < 0.02 else c for c in ("ACCTGATTGCAGGTCA" * n))
    seqs = spark.createDataFrame([(i, repeat(n)) for i, n in enumerate((1, 30, 62, 63, 64, 200))] + [(9, ""), (10, "ACG"), (11, None)], "seq_id bigint, seq string")
    p = Params(k=6, window=50, band=500)
    view = lambda df: rows(df.selectExpr("seq_id", "band", "i", "j", "round(score, 6)"))
    want = view(ani.band_cells(windows.banded(K.kmers(K.chunked(seqs, 5), 6, sketched=True), p), p).where("score >= 60"))
    for size in (64, 700, 1 << 18):
        assert view(ani.indexed_cells(stored(seqs, size), p, 60.0)) == want
    assert len({(x[0], x[1]) for x in want}) > 8


@pytest.mark.parametrize("hot", [False, True])
def test_products_equal_the_joins(spark, hot):
    """Also where one k-mer is in every window."""
    r = random.Random(7)
    sets = lambda n: [(s, band, w, x) for s in "ab" for band in (0, 1, 3, 4) for w in range(7) if r.random() < 0.8 for x in {*r.sample(range(30), n), *([99] if hot else [])}]
    plain, wide = (spark.createDataFrame(sets(n), "seq_id string, band bigint, win int, kmer int").cache() for n in (3, 6))
    assert rows(ani.dense_intersections(plain, wide, columns=4)) == rows(ani.intersections(plain, wide))
    view = lambda df: rows(df.selectExpr("seq_id", "band", "i", "j", "round(score, 6)"))
    assert view(ani.dense_cross_band(plain, wide, 5, columns=4)) == view(ani.cross_band(plain, wide, 5)) != []


def naive_spans(cells, n, tol, support=3):
    near = {(i, j) for i, j in cells} | {(j, i) for i, j in cells}
    found = {}
    for i in range(n):
        ends = []
        for step in (-1, 1):
            at, last, zeros = i + step, i, 0
            while 0 <= at < n:
                if (i, at) in near:
                    last, zeros = at, 0
                else:
                    zeros += 1
                    if zeros >= tol:
                        break
                at += step
            ends.append(last)
        found.setdefault(tuple(ends), []).append(i)
    return {k: len(v) for k, v in found.items() if len(v) >= support}


def cells(spark, pairs):
    return spark.createDataFrame([("s", 0, i, j, 90.0) for i, j in pairs], "seq_id string, band bigint, i int, j int, score double")


def test_diagonal_span_golden(spark):
    got = spans.diagonal_spans(cells(spark, [(0, 1), (0, 2), (1, 2)]), 2000, 2_000_000)
    assert [(r.start, r.end, r.cnt) for r in got.collect()] == [(0, 6000, 3)]


def test_diagonal_span_equals_scan(spark):
    for seed in range(6):
        r = random.Random(seed)
        pairs = [(i, j) for i in range(14) for j in range(i + 1, 14) if r.random() < 0.75]
        got = {(x.start, x.end - 1): x.cnt for x in spans.diagonal_spans(cells(spark, pairs), 1, 100, 2).collect()}
        assert got == naive_spans(pairs, 14, 2)


def test_attached(spark):
    c = cells(spark, [(0, 1), (0, 3)])
    assert [(r.i, r.j) for r in spans.attached_cells(c).collect()] == [(0, 1)]
    assert [(r.i, r.j) for r in spans.detached_cells(c).collect()] == [(0, 3)]


def test_off_diagonal_spans_and_matrix(spark):
    c = cells(spark, [(0, 1), (0, 3), (0, 4), (2, 5)])
    assert [(r.row_start, r.start, r.end, r.cnt) for r in spans.off_diagonal_spans(c, 10, 100).orderBy("row_start").collect()] == [(0, 30, 50, 2), (20, 50, 60, 1)]
    m = ani.matrix(c, "s", 0, 6)
    assert m[3, 0] == 90 and m[2, 2] == 100 and (m == m.T).all()


def ivs(spark, pairs):
    return spark.createDataFrame([("s", a, z) for a, z in pairs], "seq_id string, start bigint, end bigint")


def pairs(df):
    return [(r.start, r.end) for r in df.orderBy("start", "end").collect()]


def test_interval_rules_golden(spark):
    assert pairs(intervals.without_conflicts(ivs(spark, [(0, 10000), (2000, 30000), (4000, 6000), (12000, 20000)]), ["seq_id"], 2000)) == [(0, 10000), (12000, 20000)]
    ordered = spark.createDataFrame([("s", 0, 0, 10), ("s", 1, 5, 10), ("s", 2, 5, 20), ("s", 3, 0, 7)], "seq_id string, n int, start bigint, end bigint")
    assert pairs(intervals.without_repeats(ordered, ["seq_id"], ("n",))) == [(0, 10), (5, 20)]
    assert pairs(intervals.stitched(ivs(spark, [(99999, 1999999), (2000000, 2099999)]), ["seq_id"], 2_000_000, 2000)) == [(99999, 2099999)]
    assert pairs(intervals.stitched(ivs(spark, [(99999, 1999999), (2300000, 2399999)]), ["seq_id"], 2_000_000, 2000)) == [(99999, 1999999), (2300000, 2399999)]


def test_conflict_filter_leaves_no_conflict(spark):
    r = random.Random(3)
    got = pairs(intervals.without_conflicts(ivs(spark, [(a := r.randrange(500), a + r.randrange(1, 90)) for _ in range(60)]), ["seq_id"], 5))
    for x in range(len(got)):
        for y in range(x):
            (a, b), (c, d) = got[y], got[x]
            assert abs(a - c) > 5 and abs(b - d) > 5 and not (a < c and b > d)


def test_groups_of_intervals(spark):
    """One sequence's intervals are dealt out to many tasks; rows are those of one list, whatever the bins."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    table = spark.createDataFrame([(k, a := r.randrange(-50, 4000), a + r.randrange(1, 60)) for k in ("s", None) for _ in range(150)] + [("s", 3000, 2900), ("s", -400, 5)], "seq_id string, start bigint, end bigint").distinct().cache()
    whole = table.withColumn(intervals.GROUP, F.lit(1).cast("bigint"))
    for bin_ in (1, 10, 300, 10**6):
        got = intervals.grouped(table, ["seq_id"], 5, bin_).cache()
        assert got.count() == table.count()
        seen = {}
        for x in got.collect():
            seen.setdefault((x.seq_id, x[intervals.GROUP]), []).append((min(x.start, x.end), max(x.start, x.end)))
        for key in ("s", None):
            groups = sorted((min(a for a, _ in v), max(z for _, z in v)) for (k, _), v in seen.items() if k == key)
            assert all(a2 > z1 + 5 for (_, z1), (a2, _) in zip(groups, groups[1:], strict=False)) and (len(groups) > 10 or bin_ > 100)
        for rule in (lambda t: intervals.without_conflicts(t, ["seq_id"], 5), lambda t: intervals.without_repeats(t, ["seq_id"])):
            assert rows(rule(got).drop(intervals.GROUP)) == rows(rule(whole).drop(intervals.GROUP)) == rows(rule(table))
        joined = intervals.grouped(table, ["seq_id"], 8, bin_)
        assert rows(intervals.stitched(joined, ["seq_id"], 100, 2)) == rows(intervals.stitched(whole, ["seq_id"], 100, 2)) == rows(intervals.stitched(table, ["seq_id"], 100, 2))
    many = intervals.without_conflicts(intervals.grouped(spark.range(0, 10**7, 1000).selectExpr("'one' as seq_id", "id as start", "id + 300 as end"), ["seq_id"], 5, 10_000), ["seq_id"], 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({x.p for x in many.select(F.spark_partition_id().alias("p")).distinct().collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def slow_kept(found, clash):
    kept = []
    for x in sorted(found):
        if not any(clash(y, x) for y in kept):
            kept.append(x)
    return kept


def test_interval_rules_by_hand(spark):
    r = random.Random(5)
    spans = [(n, a := r.randrange(300), a + r.randrange(1, 60)) for n in "abc" for _ in range(70)] + [(None, 3, 9), (None, 4, 12)]
    table = spark.createDataFrame(spans, "seq_id string, start bigint, end bigint").repartition(3)
    near = lambda y, x: abs(y[0] - x[0]) <= 4 or abs(y[1] - x[1]) <= 4 or y[0] < x[0] and y[1] > x[1]
    same = lambda y, x: y[0] == x[0] or y[1] == x[1]
    for got, clash in ((intervals.without_conflicts(table, ["seq_id"], 4), near), (intervals.without_repeats(table, ["seq_id"]), same)):
        want = [(n, *x) for n in ("a", "b", "c", None) for x in slow_kept([s[1:] for s in spans if s[0] == n], clash)]
        assert rows(got) == sorted(want, key=repr)
    assert rows(intervals.stitched(table.limit(0), ["seq_id"], 100, 2)) == []


def test_top_classes(spark):
    q = spark.createDataFrame([("q", 1), ("q", 2), ("r", 9)], "query_id string, kmer int")
    d = spark.createDataFrame([("d", 1), ("d", 2), ("b", 2), ("a", 7), ("c", 7), ("e", 7), ("f", 7)], "class string, kmer int")
    got = [(r.query_id, r["class"], r.overlap, r["rank"]) for r in classify.top(q, d, 3).orderBy("query_id", "rank").collect()]
    assert got == [("q", "d", 2, 1), ("q", "b", 1, 2), ("q", "a", 0, 3), ("r", "a", 0, 1), ("r", "b", 0, 2), ("r", "c", 0, 3)]
    assert [(r["class"], r.overlap) for r in classify.overlaps(q, d).where("query_id = 'r'").collect()] == [(None, 0)]


def test_bars():
    assert boundaries.bars({2: 2, 4: 1}, 2) == "#\n# #\n---" and boundaries.bars({}) == ""


def test_distances_by_name(spark):
    seqs = spark.createDataFrame([("f", "c", "ACGACGACGTT")], "file string, seq_id string, seq string")
    regions = spark.createDataFrame([("c", 0, 11, "X"), ("c", 0, 2, "y"), ("no", 0, 9, "x")], "chrom string, start bigint, end bigint, name string")
    assert [(r.name, [tuple(x) for x in r.top]) for r in periodicity.by_name(regions, seqs, 3).collect()] == [("x", [(3, 3)])]


def test_last_hit_golden():
    hits = np.zeros(60, bool)
    hits[[*range(21), 30, 41]] = True
    assert boundaries.last_hit(hits) == 30
    assert boundaries.last_hit(np.zeros(5, bool)) is None


def test_last_match_golden():
    v, core = np.array([9, 9, 9, 1, 9, 2, 9, 9, 9, 9]), np.array([1, 2])
    assert [boundaries.last_match(v, core, *x) for x in ((2, 8), (6, 8), (8, 12))] == [5, 6, 8]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.integers(1, 9))
def test_chunk_counts_by_hand(values, n):
    core, length = np.array([1, 2, 3]), max(1, math.ceil(len(values) / n))
    want = [len({v for v in values[i * length : (i + 1) * length] if v in (1, 2, 3)}) for i in range(n)]
    assert boundaries.chunk_counts(np.array(values, np.int32), core, n).tolist() == want


def test_distances_golden(spark):
    k = spark.createDataFrame([("s", i, ord(c)) for i, c in enumerate("ABAAB")], "seq_id string, pos bigint, kmer int")
    assert [r.distance for r in periodicity.distances(k).orderBy("pos").collect()] == [2, 1, 3]
    assert [r.distance for r in periodicity.most_common(periodicity.histogram(k), 2).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize("db, name, pct", [({"X": [1]}, "Unknown", 25.0), ({"X": [1], "Y": [1, 2]}, "Y", 50.0), ({"X": [9]}, "Unknown", 0.0)])
def test_classify_golden(spark, db, name, pct):
    q = spark.createDataFrame([("q", x) for x in (1, 2, 3, 4)], "query_id string, kmer int")
    d = spark.createDataFrame([(c, x) for c, xs in db.items() for x in xs], "class string, kmer int")
    got = classify.best(classify.overlaps(q, d)).first()
    assert (got.name, got.pct) == (name, pct)


def test_mask(spark):
    s = spark.createDataFrame([("a", "ACGTACGT"), ("b", None), ("c", "AC")], "seq_id string, seq string")
    m = spark.createDataFrame([("a", 2, 4), ("a", 3, 99), ("c", -5, 1), ("b", 0, 1)], "seq_id string, start bigint, end bigint")
    assert dict(rows(mask.masked(s, m))) == {"a": "ACNNNNNN", "b": None, "c": "NC"}
    assert dict(rows(mask.masked(s, m, soft=True)))["a"] == "ACgtacgt"


def test_mask_choice(spark):
    n = spark.createDataFrame([("a", 0, 9, "aSat"), ("a", 20, 30, "hsat")], "seq_id string, start bigint, end bigint, name string")
    p = spark.createDataFrame([("a", 20, 30, 171)], "seq_id string, start bigint, end bigint, period bigint")
    assert len(rows(mask.chosen(n))) == 2
    assert [r[1] for r in rows(mask.chosen(n, ("ASAT",)))] == [0]
    assert [r[1] for r in rows(mask.chosen(n, (171,), p))] == [20]
    assert mask.as_length("171") == 171 and mask.as_length("x1") == "x1"


def test_lookups(spark):
    bed = spark.createDataFrame([("c1", 0, 3, "N"), ("c9", 0, 3, "N")], "chrom string, start bigint, end bigint, name string")
    seqs = spark.createDataFrame([("f2", "c1", "TTTTT"), ("f1", "c1", "ACGTA")], "file string, seq_id string, seq string")
    assert rows(lookups.missing_chroms(bed, seqs.select("seq_id"))) == [("c9",)]
    assert [r.file for r in lookups.first_source(bed, seqs, "file").collect()] == ["f1"]
    subs = spark.createDataFrame([("a", 1), ("b", 2)], "subtype string, kmer int")
    assert rows(lookups.classed(subs, spark.createDataFrame([("X", "A"), ("X", "zz")], "class string, subtype string"))) == [("X", "a", 1)]


def test_a_bucketed_database_is_not_shuffled(spark):
    from tandemlake.sources import kmerdb

    r = random.Random(6)
    q = spark.createDataFrame([(i % 7, r.randrange(-500, 500)) for i in range(900)], "query_id int, kmer int")
    d = spark.createDataFrame([(c, r.randrange(-500, 500)) for c in "abc" for _ in range(300)], "class string, kmer int")
    stored = kmerdb.bucketed(d)
    want, got = rows(classify.best(classify.overlaps(q, d), 10)), classify.best(classify.overlaps(q, stored), 10)
    assert rows(got) == want and want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = classify.best(classify.overlaps(q, stored), 10)
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    above, now = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < now:
            above.append(line)
            now = depth(line)
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in above[:join])
