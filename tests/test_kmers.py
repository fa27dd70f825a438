import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemlake.functions import kmers as K
from tandemlake.functions.names import region

from .conftest import rows


def plain_murmur(data: bytes, seed: int) -> int:
    m, h = 0xFFFFFFFF, seed
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    for i in range(0, len(data) - 3, 4):
        k = rotl(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rotl(h ^ k, 13) * 5 + 0xE6546B64) & m
    if len(data) % 4:
        h ^= rotl(int.from_bytes(data[len(data) // 4 * 4 :], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_murmur_golden():
    of = lambda s, seed: int(K.murmur3(np.frombuffer(s, np.uint8), len(s), seed).view(np.int32)[0])
    assert of(b"foo", 0) == -156908512 and of(b"foo", 42) == -1322301282
    for w, f in ((b"ACGTACGTACGTACGTACGTA", 494041287), (b"AAAAAAAAAAAAAAAAAAAAA", 1779352653), (b"GATTACAGATTACAGATTACA", 869673414), (b"CCATTCCATTCCATTCCATTC", -1364264655)):
        assert of(w, 42) == f == plain_murmur(w, 42)


def test_canonical_golden():
    for w, c in ((b"ACGTACGTACGTACGTACGTA", -1728247930), (b"AAAAAAAAAAAAAAAAAAAAA", -744158961), (b"GATTACAGATTACAGATTACA", -1438854692), (b"CCATTCCATTCCATTCCATTC", -1364264655)):
        assert K.canonical(w, 21).tolist() == [c]
    assert [x == 0 for x in K.canonical(b"ACGTN", 3)] == [False, False, True]
    assert len(K.canonical(b"AC", 3)) == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=0, max_size=60), st.integers(3, 23))
def test_canonical_is_strand_free(seq, k):
    rc = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert K.canonical(seq.encode(), k).tolist() == K.canonical(rc.encode(), k)[::-1].tolist()
    assert K.canonical(seq.encode(), k).tolist() == [min(plain_murmur(w.encode(), 42), plain_murmur(w[::-1].translate(str.maketrans("ACGT", "TGCA")).encode(), 42)) for w in (seq[i : i + k] for i in range(len(seq) - k + 1))]


def test_builtin_and_numpy_agree(spark):
    seqs = spark.createDataFrame([("a", "ACGTNACGTTTGCAacgatRA"), ("b", ""), ("c", None), ("d", "AC")], "seq_id string, seq string")
    assert rows(K.kmers_builtin(seqs, 8)) == rows(K.kmers(seqs, 8))
    whole, pieces = K.kmers(seqs, 5), K.kmers(K.chunked(seqs, 4, 3), 5)
    assert rows(whole) == rows(pieces)
    assert rows(K.kmers(seqs, 5, sketched=True)) == rows(K.sketch(whole))


def test_reverse_only_and_ambiguous(spark):
    assert [K.reverse_only(w, 21)[0] for w in (b"ACGTACGTACGTACGTACGTA", b"CCATTCCATTCCATTCCATTC")] == [-1728247930, -433094032]
    seqs = spark.createDataFrame([("a", "NNNNACGT"), ("b", "TT")], "seq_id string, seq string")
    forward = K.kmers(seqs, 4, values_of=lambda s, k: K.murmur3(np.frombuffer(s, np.uint8), k).view(np.int32))
    assert len(rows(K.without_ambiguous(forward, 4))) == 4 and len(rows(K.record_kmers(seqs, "a", 4))) == 5


def test_forward_and_reverse(spark):
    seqs = spark.createDataFrame([("a", "acgT")], "seq_id string, seq string")
    assert rows(K.forward_kmers(seqs, 3)) == [("a", 0, "ACG"), ("a", 1, "CGT")]
    assert seqs.select(K.reverse_complement(seqs.seq)).first()[0] == "Agca"


def test_region_names(spark):
    names = ["chrY:50-3000", "HG002_chr13_MATERNAL:1-4000000:1000000-3000000", "chr1", "chr1.1:5-9", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[1] and tuple(r[1]) for r in df.select("i", region(df.n)).orderBy("i").collect()]
    assert got == [("chrY", 50, 3000), ("HG002_chr13_MATERNAL", 1000000, 3000000), None, None, None]
