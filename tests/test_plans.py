import gzip
import random
import struct

import numpy as np
import pytest

from tandemlake import cli
from tandemlake.plans.annotate import annotate, periods, raw_spans
from tandemlake.plans.build_db import build_db
from tandemlake.plans.params import Params
from tandemlake.sources import bed, fasta, kmerdb
from tandemlake.streaming.arrivals import annotate_arrivals

from .conftest import rows


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def array(r, monomer, n, rate):
    out = []
    while len(out) < n:
        out += [r.choice("ACGT") if r.random() < rate else c for c in monomer]
    return "".join(out[:n])


@pytest.fixture(scope="module")
def genome():
    r = random.Random(5)
    a, b = dna(r, 171), dna(r, 68)
    return {
        "one": dna(r, 60_000) + array(r, a, 40_000, 0.01) + dna(r, 60_000),
        "edge": dna(r, 70_000) + array(r, b, 60_000, 0.01) + dna(r, 40_000),
        "start": array(r, a, 30_000, 0.01) + dna(r, 30_000),
        "short": dna(r, 900),
        "empty": "",
        "unknown": "N" * 30_000,
    }, {"alpha": a, "beta": b}


P = Params(k=21, window=2000, band=100_000)


def test_planted_arrays(spark, genome):
    seqs = spark.createDataFrame(list(genome[0].items()), "seq_id string, seq string")
    db = spark.createDataFrame([("alpha", genome[0]["one"][62_000:98_000]), ("beta", genome[0]["edge"][72_000:128_000])], "seq_id string, seq string")
    from tandemlake.functions.kmers import kmers

    db = kmers(db, 21).where("kmer <> 0").selectExpr("seq_id as class", "kmer").distinct()
    found = annotate(seqs, P, db).cache()
    got = {}
    for x in found.collect():
        got.setdefault(x.seq_id, []).append((x.start, x.end, x.name))
    assert set(got) == {"one", "edge", "start"}
    (a, z, name), = got["one"]
    assert abs(a - 60_000) <= 300 and abs(z - 100_000) <= 300 and name == "alpha"
    assert min(x[0] for x in got["edge"]) <= 70_500 and max(x[1] for x in got["edge"]) >= 129_500 and {x[2] for x in got["edge"]} == {"beta"}
    assert got["start"][0][0] <= 2000 and abs(got["start"][0][1] - 30_000) <= 300
    period = {(x.seq_id, x.period) for x in periods(found, seqs, 21).collect()}
    assert ("one", 171) in period and ("edge", 68) in period


def test_bad_parameters():
    with pytest.raises(ValueError):
        Params(window=300, band=1000)


def test_empty_input(spark):
    seqs = spark.createDataFrame([], "seq_id string, seq string")
    assert rows(annotate(seqs, P)) == [] and rows(raw_spans(seqs, P)) == []


def test_fasta_roundtrip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 some text\nACGT\nac\n>s2\n>s3\nNNA\n")
    got = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
    assert [r[1:] for r in rows(got)] == [("s1", "ACGTac", 6), ("s2", "", 0), ("s3", "NNA", 3)]
    assert sorted(r.seq_id for r in fasta.names(got).collect()) == ["s1", "s2", "s3"]
    part = fasta.selected(got, ["s3", "s1:1-3", "no"])
    assert {(r.seq_id, r.seq) for r in part.collect()} == {("s3", "NNA"), ("s1:1-3", "CG")}
    fasta.write_fasta(got.where("seq_len > 0"), str(tmp_path / "out"))
    back = fasta.read_fasta(spark, [str(tmp_path / "out" / "record=s1"), str(tmp_path / "out" / "record=s3")])
    assert {(r.seq_id, r.seq) for r in back.collect()} == {("s1", "ACGTac"), ("s3", "NNA")}


def test_records_begin_only_at_a_line(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"\n\n>s1 length>1000 note\r\nAC>GT\r\n\r\nac\r\n>s2\n>\n\n>s3\tx\nNN\nA")
    want = [("s1", "AC>GTac", 7), ("s2", "", 0), ("s3", "NNA", 3)]
    assert [r[1:] for r in rows(fasta.read_fasta(spark, str(tmp_path / "a.fa")))] == want
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_bytes((tmp_path / "a.fa").read_bytes())
    stream = fasta.records(spark.readStream.option("lineSep", fasta.SEPARATOR).text(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("arrived")) == [w[:2] for w in want]


def test_first_file_and_whole_names_come_first(spark):
    seqs = spark.createDataFrame([("f2", "a", "ACGT"), ("f1", "a", "TTTT"), ("f3", "a:1-2", "GG")], "file string, seq_id string, seq string")
    assert {(r.seq_id, r.file, r.seq) for r in fasta.selected(seqs, ["a", "a:1-2", "a:0-3"]).collect()} == {("a", "f1", "TTTT"), ("a:1-2", "f3", "GG"), ("a:0-3", "f1", "TTT")}


def joined_columns(node):
    """The columns that go into the joins of a plan."""
    kids = [node.children().apply(i) for i in range(node.children().size())]
    own = [set(k.output().mkString(",").split(",")) for k in kids] if node.nodeName() == "Join" else []
    return [*own, *(c for k in kids for c in joined_columns(k))]


def test_no_sequence_goes_through_a_join(spark, genome):
    seqs = spark.createDataFrame(list(genome[0].items()), "seq_id string, seq string")
    source = seqs._jdf.queryExecution().optimizedPlan().output().apply(1).toString()
    db = spark.createDataFrame([("x", 1)], "class string, kmer int")
    regions = spark.createDataFrame([("one", 0, 99, "n")], "chrom string, start bigint, end bigint, name string")
    for df in (annotate(seqs, P, db), build_db(regions, seqs.selectExpr("'f' as file", "seq_id", "seq"), 21)):
        found = joined_columns(df._jdf.queryExecution().optimizedPlan())
        assert len(found) >= 4 and not any(source in columns for columns in found)


def test_slices_are_regions(spark):
    from tandemlake.functions.kmers import kmers, slices

    r = random.Random(8)
    seqs = {n: dna(r, size) for n, size in (("a", 95), ("b", 30), ("c", 3))}
    regions = [(i, n, a, a + r.randrange(-3, 60)) for i, (n, a) in enumerate((r.choice("abcd"), r.randrange(-10, 100)) for _ in range(80))]
    table = spark.createDataFrame(regions, "i int, seq_id string, start bigint, end bigint")
    got = {}
    for x in kmers(slices(table, spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), 4, ["i"], size=16), 4).collect():
        got.setdefault(x.seq_id.i, []).append((x.pos, x.kmer))
    from tandemlake.functions.kmers import canonical

    for i, n, a, z in regions:
        part = seqs.get(n, "")[max(0, a) : max(0, z)]
        assert sorted(got.get(i, [])) == [(max(0, a) + j, int(v)) for j, v in enumerate(canonical(part.encode(), 4))]


def slow_refined(seq, start, end, window, k):
    """A span's new ends, from strings: sets of canonical words instead of hashes."""
    comp = str.maketrans("ACGT", "TGCA")
    w = window if end - start >= 4 * window else max(1, (end - start) // 4)
    h = -(-w // 2)
    words = lambda a, z: [min(x, x[::-1].translate(comp)) for x in (seq[i : i + k] for i in range(max(0, a), min(z, len(seq)) - k + 1))]
    core = set(words(start + w + h, end - w - h))

    def look(a, z, left):
        zone = words(a, z)
        if not zone:
            return None
        n = -(-len(zone) // 100)
        size = -(-len(zone) // n)
        hit = [len({x for x in zone[c * size : (c + 1) * size] if x in core}) > -(-n // 4) for c in range(n)]
        order, last, misses = (range(n - 1, -1, -1) if left else range(n)), None, 0
        for c in order:
            last, misses = (c, 0) if hit[c] else (last, misses + 1)
            if misses >= 10:
                break
        if last is None:
            return None
        at = [i for i in range(max(0, (last - 1) * size), min(len(zone), (last + 2) * size)) if zone[i] in core]
        return max(0, a) + (at[0] if left else at[-1])

    first = lambda *zones: next((x for x in (look(*z) for z in zones) if x is not None), None)
    a = first((start - w - h, start + w + h, True), (start + w, start + w + 5 * h, True))
    z = first((end - w - h, end + w + h, False), (end - w - 5 * h, end - w, False))
    return (start, end, False) if a is None or z is None or a >= z + k else (a, z + k, True)


def test_refinement_by_hand(spark):
    from tandemlake.operators import boundaries

    r = random.Random(12)
    seqs, spans = {}, []
    for n in range(14):
        before, size = r.randrange(0, 3000), r.randrange(1500, 9000)
        seqs[f"s{n}"] = dna(r, before) + array(r, dna(r, r.randrange(20, 200)), size, 0.01) + dna(r, r.randrange(0, 3000))
        for _ in range(3):
            a, z = max(0, before + r.randrange(-900, 900)), before + size + r.randrange(-900, 900)
            if a < z:
                spans.append((f"s{n}", a, z))
    spans += [("s0", 5, 9), ("s1", 0, 700), ("none", 0, 4000)]
    got = boundaries.refined(spark.createDataFrame(spans, "seq_id string, start bigint, end bigint"), spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), 400, 11)
    want = {s: slow_refined(seqs.get(s[0], ""), *s[1:], 400, 11) for s in spans}
    assert {(x.seq_id, x.raw_start, x.raw_end): (x.start, x.end, x.refined) for x in got.collect()} == want
    assert sum(x[2] for x in want.values()) > 15 and not all(x[2] for x in want.values())


def test_compat_moves_what_it_says(spark, genome):
    seqs = spark.createDataFrame([("one", genome[0]["one"]), ("r:1-9", genome[0]["one"])], "seq_id string, seq string")
    plain = {x.seq_id: (x.start, x.end) for x in annotate(seqs, P).collect()}
    odd = {x.seq_id: (x.start, x.end, x.refined) for x in annotate(seqs, Params(k=21, window=2000, band=100_000, compat=True)).collect()}
    assert set(odd) == set(plain) and all(x[2] for x in odd.values())
    assert all(abs(odd[n][0] - plain[n][0]) <= 200 + 21 and abs(odd[n][1] - plain[n][1]) <= 200 for n in odd)
    bare = {x.seq_id: x.start for x in annotate(seqs, Params(k=21, window=2000, band=100_000, compat=True), refine=False).collect()}
    assert bare["one"] == bare["r:1-9"] - 1


def test_a_database_of_another_k_raises(spark, genome):
    seqs = spark.createDataFrame([("short", genome[0]["short"])], "seq_id string, seq string")
    with pytest.raises(ValueError, match="31"):
        annotate(seqs, P, spark.createDataFrame([("a", 31, 5)], "class string, k int, kmer int"))


def test_missing_databases(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        kmerdb.read_dbs(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError):
        kmerdb.read_dbs(spark, str(tmp_path))
    (tmp_path / "x.db").write_text("x")
    with pytest.raises(ValueError):
        kmerdb.read_dbs(spark, str(tmp_path / "x.db"))
    assert rows(kmerdb.read_dbs(spark, str(tmp_path), permissive=True)) == []


def test_written_database_has_the_formats_bytes(spark, tmp_path):
    db = spark.createDataFrame([("A", s, (i * 7919) % 4001 - 2000) for s in "xy" for i in range(3000)] + [("B", "é", 1)], "class string, subtype string, kmer int")
    kmerdb.write_dbs(db, 13, str(tmp_path))
    for c in "AB":
        sets = {}
        for r in db.where(f"class = '{c}'").distinct().orderBy("subtype", "kmer").collect():
            sets.setdefault(r.subtype, []).append(r.kmer)
        assert gzip.decompress((tmp_path / f"{c}.db").read_bytes()) == gzip.decompress(kmerdb.encode(13, {s: np.array(v) for s, v in sets.items()}))


def test_sets_are_dealt_out(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(kmerdb, "PART", 500)
    db = spark.createDataFrame([(c, s, (i * 7919) % 4001 - 2000) for c in ("A", "B b") for s in "wxyz" for i in range(1500)], "class string, subtype string, kmer int")
    kmerdb.write_dbs(db, 13, str(tmp_path))
    want = rows(db.distinct().selectExpr("class", "subtype", "13 as k", "kmer"))
    got = kmerdb.read_dbs(spark, str(tmp_path))
    assert rows(got) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = got.select(F.spark_partition_id().alias("p"), "class", "subtype").distinct().groupBy("class").agg(F.countDistinct("p").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n for r in per) > 1
    (tmp_path / "A.db.sets").unlink()
    with open(tmp_path / "B%20b.db.sets", "r+b") as f:  # of other bytes
        f.truncate(16)
    assert rows(kmerdb.read_dbs(spark, str(tmp_path))) == want
    whole = (tmp_path / "A.db").read_bytes()
    (tmp_path / "A.db").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        kmerdb.read_dbs(spark, str(tmp_path)).collect()
    assert {r["class"] for r in kmerdb.read_dbs(spark, str(tmp_path), permissive=True).collect()} == {"B b"}


def test_no_two_sequences_share_a_file(spark, tmp_path):
    t = bed.annotation(spark.createDataFrame([("a/b", 5, 9, "x"), ("a/b", 1, 3, None), ("a_b", 0, 2, "y")], "seq_id string, start bigint, end bigint, name string"))
    bed.write_table(t, str(tmp_path / "o"))
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")) == ["a%2Fb.bed", "a_b.bed"]
    assert (tmp_path / "o" / "a%2Fb.bed").read_text() == "\t".join(bed.ANNOTATION) + "\na/b\t1\t3\t.\t0\t.\t1\t3\t0,0,0\na/b\t5\t9\tx\t0\t.\t5\t9\t0,0,0\n"


def test_region_slice(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ACGTA", 0, 2), ("ACGTA", 3, 99), ("ACGTA", 4, 2)], "s string, a bigint, z bigint")
    assert [r[0] for r in df.select(fasta.region(F.col("s"), F.col("a"), F.col("z"))).collect()] == ["AC", "TA", None]
    assert df.select(fasta.region(F.col("s"), F.lit(0), F.lit(5), compat=True)).first()[0] == "CGTA"
    named = spark.createDataFrame([("chrY:50-3000", 0, 100)], "seq_id string, start bigint, end bigint")
    assert tuple(bed.placed(named, compat=True).first())[1:] == (50, 149)


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nbrowser y\n#c\n\nc1\t1\t5\tN\tx\nc2\t2\t6\tM\ty\tmore\n")
    got = bed.read_bed(spark, str(tmp_path / "a.bed"))
    assert got.columns == ["chrom", "start", "end", "name", "score"] and len(rows(got)) == 2
    assert rows(bed.normalised(got))[0] == ("c1", 1, 5, "N")
    assert rows(bed.normalised(got.drop("name")))[0][3] == "c1"
    (tmp_path / "b.bed").write_text("c1\t1\t5\nc2\t2\n")
    with pytest.raises(Exception, match="fewer than 3"):
        bed.read_bed(spark, str(tmp_path / "b.bed")).collect()
    with pytest.raises(ValueError):
        bed.normalised(got.drop("start"))


@pytest.mark.parametrize("fmt", bed.FORMATS)
def test_formats(spark, tmp_path, fmt):
    t = bed.annotation(bed.placed(spark.createDataFrame([("chrY:50-3000", 0, 100, "x")], "seq_id string, start bigint, end bigint, name string")))
    assert (t.first().start, t.first().end) == (50, 150)
    bed.write_table(t, str(tmp_path / fmt), fmt)
    text = "".join(p.read_text() for p in (tmp_path / fmt).rglob("*.bed" if fmt == "bed" else "part-*"))
    assert {"bed": "#chrom\tstart", "gtf": 'gene_id "x";', "gff": "ID=x", "csv": "#chrom,start", "tsv": "#chrom\tstart", "json": '"start":50'}[fmt] in text
    with pytest.raises(ValueError):
        bed.write_table(t, str(tmp_path / "no"), "xml")


def test_db_bytes_and_roundtrip(spark, tmp_path):
    assert gzip.decompress(kmerdb.encode(21, {"a": np.array([-1])})) == bytes.fromhex("15 01 00 01 00 61 01 00 00 00 ff ff ff ff".replace(" ", ""))
    db = spark.createDataFrame([("A", "x", 5), ("A", "x", -7), ("A", "y", 5), ("B/b", "z", 1)], "class string, subtype string, kmer int")
    kmerdb.write_dbs(db, 21, str(tmp_path))
    got = kmerdb.read_dbs(spark, str(tmp_path))
    assert rows(got) == sorted([("A", "x", 21, -7), ("A", "x", 21, 5), ("A", "y", 21, 5), ("B/b", "z", 21, 1)], key=repr)
    (tmp_path / "bad.db").write_bytes(gzip.compress(struct.pack("<BH", 21, 1)))
    assert len(rows(kmerdb.read_dbs(spark, str(tmp_path), permissive=True))) == 4
    with pytest.raises(Exception):
        kmerdb.read_dbs(spark, str(tmp_path)).collect()


def test_build_db_unites_names(spark):
    regions = spark.createDataFrame([("c", 0, 8, "X"), ("c", 4, 12, "x"), ("c", 0, 4, "y")], "chrom string, start bigint, end bigint, name string")
    seqs = spark.createDataFrame([("f", "c", "ACGTTGCAACCA")], "file string, seq_id string, seq string")
    got = build_db(regions, seqs, 4)
    assert {r["class"] for r in got.collect()} == {"x", "y"}
    mapped = build_db(regions, seqs, 4, kmerdb.class_map(spark, {"K": ["X", "none"]}))
    assert {(r["class"], r.subtype) for r in mapped.collect()} == {("K", "x")}


def test_command_line(spark, tmp_path, genome, capsys):
    fa = tmp_path / "g.fa"
    fa.write_text("".join(f">{n}\n{s}\n" for n, s in genome[0].items() if n in ("one", "short")))
    (tmp_path / "r.bed").write_text("one\t70000\t90000\tAlpha\n")
    (tmp_path / "c.json").write_text('{"sat": ["alpha"]}')
    cli.run(spark, cli.parser().parse_args(["build_db", "-f", str(fa), "-b", str(tmp_path / "r.bed"), "-c", str(tmp_path / "c.json"), "-d", str(tmp_path / "db"), "-v"]))
    cli.run(spark, cli.parser().parse_args(["annotate", "-f", str(fa), "-d", str(tmp_path / "out"), "-c", str(tmp_path / "db"), "--band", "0.1", "-m", "SAT", "-p", "-v"]))
    said = capsys.readouterr().out
    assert "2 sequences" in said and "sat: 1 subtypes" in said and "one:" in said and "#" in said and "1 arrays" in said
    picture = (tmp_path / "out" / "plots" / "one.0.pgm").read_bytes()
    assert picture.startswith(b"P5 50 50 255\n") and len(picture) == 13 + 2500 and picture[13] == 0
    text = (tmp_path / "out" / "annotation" / "one.bed").read_text()
    assert "\tsat\t" in text and text.startswith("#chrom\tstart\tend")
    assert sorted(p.name for p in (tmp_path / "out" / "masked").iterdir() if not p.name.startswith(".")) == ["one.fa", "short.fa"]
    masked = fasta.read_fasta(spark, str(tmp_path / "out" / "masked" / "one.fa")).first().seq
    assert masked[70_000:90_000] == "N" * 20_000 and "N" not in masked[:59_000]


def test_command_line_of_a_range(spark, tmp_path, genome, capsys):
    fa = tmp_path / "g.fa"
    fa.write_text("".join(f">{n}\n{s}\n" for n, s in genome[0].items()))
    cli.run(spark, cli.parser().parse_args(["annotate", "-f", str(fa), "-s", "one:50000-120000", "nowhere", "-d", str(tmp_path / "out"), "--band", "0.1", "-m", "ALL", "--soft"]))
    assert "no sequence nowhere" in capsys.readouterr().out
    line = (tmp_path / "out" / "annotation" / "one:50000-120000.bed").read_text().splitlines()[1].split("\t")
    assert abs(int(line[1]) - 60_000) <= 300 and abs(int(line[2]) - 100_000) <= 300
    masked = fasta.read_fasta(spark, str(tmp_path / "out" / "masked" / "one%3A50000-120000.fa")).first().seq
    assert masked.upper() == genome[0]["one"][50_000:120_000] and masked[12_000:48_000].islower() and masked[:8000].isupper()


def test_a_run_that_fails_changes_nothing(spark, tmp_path):
    rows_ = spark.createDataFrame([(n, 0, 5, "x") for n in "abc"], "seq_id string, start bigint, end bigint, name string")
    out = tmp_path / "o"
    bed.write_table(bed.annotation(rows_), str(out))
    before = {p.name: p.read_text() for p in out.iterdir() if not p.name.startswith(".")}
    from pyspark.sql import functions as F

    bad = rows_.withColumn("start", F.when(F.col("seq_id") == "c", F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("start") + 1))
    with pytest.raises(Exception, match="broken"):
        bed.write_table(bed.annotation(bad), str(out))
    assert {p.name: p.read_text() for p in out.iterdir() if not p.name.endswith(".crc")} == before
    bed.write_table(bed.annotation(rows_.where("seq_id <> 'b'").unionByName(rows_.limit(1).withColumn("seq_id", F.lit(None).cast("string")))), str(out))
    assert sorted(p.name for p in out.iterdir() if not p.name.endswith(".crc")) == ["%.bed", "a.bed", "c.bed"]


def test_masked_files_of_odd_names(spark, tmp_path):
    from tandemlake.operators import mask
    from tandemlake.sources import indexed

    r = random.Random(4)
    seqs = {"a/b": dna(r, 500), "a_b": dna(r, 61), "a b": dna(r, 60), "": "", "é%": dna(r, 7)}
    table = spark.createDataFrame([(n, s) for n, s in seqs.items()] + [("a_b", "ACGT")], "seq_id string, seq string")
    marks = spark.createDataFrame([("a/b", -5, 10), ("a/b", 5, 130), ("a/b", 490, 900), ("a_b", 60, 61), ("none", 0, 9), ("a b", 7, 7)], "seq_id string, start bigint, end bigint")
    want = {**seqs, "a/b": "N" * 130 + seqs["a/b"][130:490] + "N" * 10, "a_b": seqs["a_b"][:60] + "N"}
    got = indexed.stored(table, 64)
    mask.write_masked(got, marks, str(tmp_path))
    files = {p.name: p.read_text() for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert sorted(files) == sorted(["a%2Fb.fa", "a_b.fa", "a%20b.fa", "%00.fa", "%C3%A9%25.fa"])
    assert all(len(line) <= fasta.LINE for f in files.values() for line in f.splitlines())
    for n, s in want.items():
        mine = files[{"a/b": "a%2Fb", "a b": "a%20b", "": "%00", "é%": "%C3%A9%25"}.get(n, n) + ".fa"]
        parts = [p.replace("\n", "") for p in ("\n" + mine).split(f"\n>{n}\n")]
        assert s in parts and ("ACGT" in parts or n != "a_b")
    pieces = {}
    for x in mask.masked_pieces(got, marks, True).collect():
        pieces.setdefault(x.seq_id, []).append((x.pos0, bytes(x.seq).decode()))
    whole = "".join(q for _, q in sorted(pieces["a/b"]))
    assert whole == seqs["a/b"][:130].lower() + seqs["a/b"][130:490] + seqs["a/b"][490:].lower()


def test_arrivals(spark, tmp_path, genome):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.fa").write_text(f">one\n{genome[0]['one']}\n")
    q = annotate_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), P)
    q.awaitTermination(120)
    assert [r["#chrom"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["one"]
