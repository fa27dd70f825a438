"""Sequences by index: any line widths, borders of segments anywhere, block gzip, gzip, tables."""

import gzip
import random
import struct
import zlib

import pytest

from tandemlake.functions.kmers import canonical, kmers, slices
from tandemlake.plans.annotate import annotate
from tandemlake.plans.params import Params
from tandemlake.sources import fasta, indexed, pieces

from .conftest import rows


def bgzf(data, block):
    out = b""
    for i in range(0, len(data), block):
        c, part = zlib.compressobj(6, zlib.DEFLATED, -15), data[i : i + block]
        z = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(part), len(part))
    return out + indexed.END


@pytest.fixture(scope="module")
def made():
    """Records with lines of many widths and line ends, as {name: bases}, and the text."""
    r, seqs, text = random.Random(1), {}, "junk before\n"
    for i, (n, line, nl) in enumerate([(1000, 60, "\n"), (0, 60, "\n"), (5000, 70, "\r\n"), (3, 60, "\n"), (40_000, 40_000, "\n"), (7, 1, "\n"), (20_000, 61, "\n"), (0, 1, "\n"), (900, 60, "\n")]):
        s = "".join(r.choice("ACGTacgtN>") if j % line else "A" for j in range(n))
        seqs[f"r{i}"] = s
        text += f">r{i} some {'long ' * r.randrange(1, 60)}{nl}{nl.join(s[j : j + line] for j in range(0, n, line))}{nl if n else ''}"
    return seqs, text.rstrip("\n").encode()


def read(pieces):
    out = {}
    for x in pieces.collect():
        out.setdefault(x.seq_id, []).append((x.pos0, bytes(x.seq).decode()))
    return {k: sorted(v) for k, v in out.items()}


FORMS = {"a.fa": lambda raw: raw, "b.fa.gz": lambda raw: bgzf(raw, 50), "c.fa.gz": lambda raw: bgzf(raw, 5000), "d.fa.gz": lambda raw: gzip.compress(raw[:3000]) + gzip.compress(raw[3000:])}


@pytest.mark.parametrize("form,size,share", [("a.fa", 64, 256), ("a.fa", 7, 21), ("a.fa", indexed.SEGMENT, indexed.RANGE), ("b.fa.gz", 64, 256), ("c.fa.gz", 3000, 9000), ("c.fa.gz", indexed.SEGMENT, indexed.RANGE), ("d.fa.gz", 1000, 5000)])
def test_files(spark, tmp_path, made, form, size, share):
    seqs, raw = made
    (tmp_path / form).write_bytes(FORMS[form](raw))
    got = indexed.read_index(spark, str(tmp_path / form), size, share)
    assert sorted((x.seq_id, x.seq_len) for x in got.records().collect()) == sorted((n, len(s)) for n, s in seqs.items())
    plain = read(got.pieces())
    assert {n: "".join(q for _, q in plain.get(n, [])) for n in seqs} == seqs
    more = read(got.pieces(20))
    for n, s in seqs.items():
        at = [p for p, _ in plain.get(n, [])]
        assert [q for _, q in more.get(n, [])] == [s[p : min(e + 20, len(s))] for p, e in zip(at, [*at[1:], len(s)], strict=False)]
    r = random.Random(2)
    regions = [(i, r.choice(sorted(seqs)), a := r.randrange(-5, 41_000), a + r.randrange(0, 300)) for i in range(200)] + [(999, "r4", 0, 40_000), (1000, "r5", 0, 99)]
    found = {}
    for x in kmers(slices(spark.createDataFrame(regions, "i int, seq_id string, start bigint, end bigint"), got, 5, ["i"]), 5).collect():
        found.setdefault(x.seq_id.i, []).append((x.pos, x.kmer))
    for i, n, a, z in regions:
        part = seqs[n][max(0, a) : max(0, z)].encode()
        assert sorted(found.get(i, [])) == [(max(0, a) + j, int(v)) for j, v in enumerate(canonical(part, 5))]
    some = got.selected(["r4:100-300", "r2", "none", "r0:990-2000", "r5:9-12", "r2"])
    want = {"r4:100-300": seqs["r4"][100:300], "r2": seqs["r2"], "r0:990-2000": seqs["r0"][990:], "r5:9-12": ""}
    assert {x.seq_id: x.seq_len for x in some.records().collect()} == {n: len(s) for n, s in want.items()}
    assert {n: "".join(q for _, q in p) for n, p in read(some.pieces()).items()} == {n: s for n, s in want.items() if s}


@pytest.mark.parametrize("form", ["b.fa.gz", "c.fa.gz", "d.fa.gz"])
def test_a_file_that_breaks_off_raises(spark, tmp_path, made, form):
    whole = FORMS[form](made[1])
    (tmp_path / form).write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="breaks off"):
        indexed.read_index(spark, str(tmp_path / form))
    with pytest.raises(Exception):
        fasta.read_fasta(spark, str(tmp_path / form)).collect()


def test_a_damaged_block_raises(spark, tmp_path, made):
    whole = bytearray(bgzf(made[1], 5000))
    whole[3000] ^= 255
    (tmp_path / "x.fa.gz").write_bytes(whole)
    with pytest.raises(Exception):
        indexed.read_index(spark, str(tmp_path / "x.fa.gz"))


def test_files_without_records(spark, tmp_path):
    (tmp_path / "empty.fa").write_bytes(b"")
    (tmp_path / "none.fa").write_bytes(b"ACGT\nAC\n")
    (tmp_path / "heads.fa").write_bytes(b">\n>x y\n>")
    got = indexed.read_index(spark, [str(tmp_path / n) for n in ("empty.fa", "none.fa", "heads.fa")])
    assert sorted((x.seq_id, x.seq_len) for x in got.records().collect()) == [("", 0), ("", 0), ("x", 0)] and got.pieces().collect() == []


def test_a_long_record_is_many_tasks_work(spark, tmp_path):
    r = random.Random(3)
    s = "".join(r.choices("ACGT", k=3_000_000))
    (tmp_path / "one.fa").write_text(">x\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n")
    got = indexed.read_index(spark, str(tmp_path / "one.fa"))
    from pyspark.sql import functions as F

    parts = got.pieces(20).select(F.spark_partition_id().alias("p"), F.length("seq").alias("n")).collect()
    assert len({x.p for x in parts}) >= 4 and max(x.n for x in parts) <= indexed.SEGMENT + 20
    part = got.selected(["x:1-1000"])
    row = part.index.collect()
    assert len(row) == 1
    reader = indexed.Reader()
    x = row[0]
    assert reader.bases(x.path, x.kind, x["at"], x.skip, x.size, x.bases, 1, 1000) == s[1:1000].encode() and reader.read <= indexed.SEGMENT
    scan = part.index._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(seq_id" in scan or "PushedFilters: [IsNotNull(seq_id)" in scan or "In(seq_id" in scan


def test_tables_as_bases(spark, made):
    seqs = list(made[0].values())
    table = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)] + [(77, None)], "seq_id bigint, seq string").repartition(3)
    got = indexed.stored(table, 64)
    assert {n: "".join(q for _, q in p) for n, p in read(got.pieces()).items()} == {i: s for i, s in enumerate(seqs) if s}
    assert rows(got.records().select("seq_id", "seq_len")) == sorted([(i, len(s)) for i, s in enumerate(seqs)], key=repr)
    assert got.pieces(30).where("length(seq) > 94").count() == 0


def test_annotation_reads_texts_once(spark, tmp_path):
    """What annotate's plan scans are tables of index rows, spans and k-mers: no text, and no table of sequences."""
    r = random.Random(5)
    monomer = "".join(r.choices("ACGT", k=171))
    s = "".join(r.choices("ACGT", k=30_000)) + monomer * 180 + "".join(r.choices("ACGT", k=30_000))
    (tmp_path / "g.fa").write_text(f">one\n{s}\n")
    p, db = Params(k=21, window=2000, band=100_000), spark.createDataFrame([("a", 1)], "class string, kmer int")
    table = spark.createDataFrame([("one", s)], "seq_id string, seq string")
    spans = []
    for seqs in (indexed.read_index(spark, str(tmp_path / "g.fa")), table):
        df = annotate(seqs, p, db)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "seq#" not in "".join(x for x in plan.splitlines() if "Scan" in x)
        spans.append(rows(df))
    assert spans[0] == spans[1] and len(spans[0]) == 1


def test_a_source_of_pieces(spark, tmp_path, made):
    seqs, raw = made
    (tmp_path / "a.fa").write_bytes(raw)
    indexed.read_index(spark, str(tmp_path / "a.fa"), 64, 256).save(str(tmp_path / "index"), 100)
    back = indexed.Indexed.load(spark, str(tmp_path / "index"))
    assert {n: "".join(q for _, q in p) for n, p in read(back.pieces()).items()} == {n: s for n, s in seqs.items() if s}
    load = lambda: pieces.read_pieces(spark, str(tmp_path / "index"))
    want = read(back.pieces())
    assert read(load()) == want
    part = load().where("seq_id in ('r2', 'r6') and pos0 < 500 and pos0 >= 100")
    assert read(part) == {n: [(a, q) for a, q in want[n] if 100 <= a < 500] for n in ("r2", "r6")}
    assert read(load().where("seq_id = 'r4' and length(seq) > 60 and seq_len > 5")) == {"r4": [(a, q) for a, q in want["r4"] if len(q) > 60]}
    assert load().where("seq_id = 'nowhere'").collect() == [] and load().where("seq_id is null").collect() == []
    reader = pieces.PiecesReader(str(tmp_path / "index"))
    every = sum(p.end - p.first for p in reader.partitions())
    assert list(reader.pushFilters([pieces.EqualTo(("seq_id",), "r0"), pieces.EqualTo(("seq",), b"A"), pieces.LessThan(("pos0",), 100)])) == [pieces.EqualTo(("seq",), b"A")]
    assert all(p.end - p.first <= pieces.ROWS for p in reader.partitions()) and sum(p.end - p.first for p in reader.partitions()) < every
    got = [b.to_pylist()[0] for p in reader.partitions() for b in reader.read(p)]
    assert {(r["seq_id"], r["pos0"] < 100) for r in got} == {("r0", True)} and len(got) == sum(a < 100 for a, _ in want["r0"])
