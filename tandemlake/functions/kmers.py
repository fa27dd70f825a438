"""k-mers of DNA: canonical MurmurHash3 values, forward strings, reverse complements.

A canonical value is the smaller of the signed 32-bit hashes (x86_32, seed 42) of a k-mer and its reverse complement;
a k-mer with an ambiguous base is 0. Spark's own hash() is the same function where k is a multiple of 4, so those are
built-in expressions; other sizes, and whole genomes, are hashed in numpy, all positions of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
# The ambiguity codes, and the complement's table.
AMBIGUOUS = "RYMKSWHBVDN"
BASES, COMPLEMENTS = "ACTG", "TGAC"
#: Bases a row of chunked() holds beside its overlap.
CHUNK = 1 << 20
#: k-mers after which kmers() sends a batch on.
BATCH = 1 << 16

_complement = np.arange(256, dtype=np.uint8)
_complement[list(BASES.encode())] = list(COMPLEMENTS.encode())
_ambiguous = np.zeros(256, bool)
_ambiguous[list(AMBIGUOUS.encode())] = True


def reverse_complement(c: Column) -> Column:
    return F.translate(F.reverse(c), BASES, COMPLEMENTS)


def murmur3(b: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Hashes of all k-byte windows of b, as uint32."""
    n = len(b) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    u = np.uint32
    b = b.astype(u)
    rotl = lambda x, r: x << u(r) | x >> u(32 - r)
    mixed = lambda x: rotl(x * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = np.full(n, seed, u)
    for i in range(0, k - 3, 4):
        word = b[i : i + n] | b[i + 1 : i + 1 + n] << u(8) | b[i + 2 : i + 2 + n] << u(16) | b[i + 3 : i + 3 + n] << u(24)
        h = rotl(h ^ mixed(word), 13) * u(5) + u(0xE6546B64)
    if k % 4:
        i, word = k - k % 4, np.zeros(n, u)
        for j in range(k % 4):
            word |= b[i + j : i + j + n] << u(8 * j)
        h ^= mixed(word)
    h ^= u(k)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return h ^ h >> u(16)


def canonical(seq: bytes, k: int) -> np.ndarray:
    """The canonical values of a sequence's k-mers, by position."""
    b = np.frombuffer(seq.upper(), np.uint8)
    if len(b) < k:
        return np.zeros(0, np.int32)
    out = np.minimum(murmur3(b, k).view(np.int32), murmur3(_complement[b[::-1]], k)[::-1].view(np.int32))
    held = np.concatenate([[0], np.cumsum(_ambiguous[b])])
    out[held[k:] != held[:-k]] = 0
    return out


def reverse_only(seq: bytes, k: int) -> np.ndarray:
    """Hashes of the k-mers' reverse complements alone, by position; ambiguous bases are hashed as they stand."""
    return murmur3(_complement[np.frombuffer(seq.upper(), np.uint8)[::-1]], k)[::-1].view(np.int32)


def kmers(seqs: DataFrame, k: int, sketched: bool = False, values_of: Callable[[bytes, int], np.ndarray] = canonical, distinct: bool = False) -> DataFrame:
    """seq_id, pos, kmer for seqs(seq_id, seq[, pos0]); pos0 is where the row's piece begins in its sequence.

    sketched keeps the values that sketch() does, before they leave the worker; distinct, each value once a stretch of
    CHUNK bases (at its first place there). A null sequence has no k-mers. values_of: canonical, or reverse_only. A row
    of any length is hashed CHUNK bases at a time.
    """
    kind = seqs.schema["seq_id"].dataType.simpleString()
    rows = seqs.select("seq_id", "pos0" if "pos0" in seqs.columns else F.lit(0).cast("bigint").alias("pos0"), F.col("seq").cast("binary").alias("seq")).where("seq is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0  # of short rows many make a batch
            for i, (pos0, seq) in enumerate(zip(b.column("pos0").to_pylist(), b.column("seq").to_pylist(), strict=True)):
                for first in range(0, len(seq) - k + 1, CHUNK):
                    values = values_of(seq[first : first + CHUNK + k - 1], k)
                    at = np.arange(len(values))
                    if distinct:
                        values, at = np.unique(values, return_index=True)
                    if sketched:
                        keep = np.nonzero((values & 3 == 0) & (values != 0))[0]
                        values, at = values[keep], at[keep]
                    held.append((np.full(len(at), i), pos0 + first + at, values))
                    n += len(at)
                    if n >= BATCH:
                        yield batch(b, held)
                        held, n = [], 0
            if n:
                yield batch(b, held)

    def batch(b: pa.RecordBatch, held: list) -> pa.RecordBatch:
        i, at, values = map(np.concatenate, zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([b.column("seq_id").take(pa.array(i)), pa.array(at), pa.array(values)], ["seq_id", "pos", "kmer"])

    return rows.mapInArrow(run, f"seq_id {kind}, pos bigint, kmer int")


def kmers_builtin(seqs: DataFrame, k: int) -> DataFrame:
    """The same for k a multiple of 4, by Spark's own functions alone."""
    if k % 4:
        raise ValueError("Spark's hash differs from the canonical one unless k is a multiple of 4")
    word = forward_kmers(seqs, k)
    return word.select("seq_id", "pos", F.when(F.col("kmer").rlike(f"[{AMBIGUOUS}]"), 0).otherwise(F.least(F.hash("kmer"), F.hash(reverse_complement(F.col("kmer"))))).alias("kmer"))


def forward_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """seq_id, pos, kmer: the upper-case strings as they stand, for seqs(seq_id, seq[, pos0])."""
    pieces = seqs.where(F.length("seq") >= k) if "pos0" in seqs.columns else chunked(seqs, k - 1)
    rows = pieces.select("seq_id", "pos0", F.upper(F.col("seq").cast("string")).cast("binary").alias("seq")).where(F.length("seq") >= k)
    at = rows.select("seq_id", "pos0", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("i"))
    return at.select("seq_id", (F.col("pos0") + F.col("i")).alias("pos"), F.substring("seq", F.col("i") + 1, k).cast("string").alias("kmer"))


def record_kmers(seqs: DataFrame, seq_id: str, k: int) -> DataFrame:
    """All k-mers of one record."""
    return kmers(seqs.where(F.col("seq_id") == seq_id), k)


def without_ambiguous(kmers: DataFrame, k: int) -> DataFrame:
    """Without 0 and without the hashes of k equal ambiguous bases, which stand in lists hashed without the rule for them."""
    runs = [int(min(murmur3(np.full(k, b, np.uint8), k).view(np.int32)[0], reverse_only(bytes([b]) * k, k)[0])) for b in AMBIGUOUS.encode()]
    return kmers.where(~F.col("kmer").isin(0, *runs))


def sketch(kmers: DataFrame) -> DataFrame:
    """A quarter of the values, the same ones everywhere, without 0."""
    return kmers.where("kmer % 4 = 0 and kmer <> 0")


def taken(kmers: DataFrame, first: int, last: int) -> DataFrame:
    """The k-mers of positions first to last - 1."""
    return kmers.where(F.col("pos").between(first, last - 1))


def chunked(seqs: DataFrame, overlap: int, size: int = CHUNK) -> DataFrame:
    """Sequences in pieces of size + overlap bases: seq_id, pos0, seq. With overlap k - 1 each k-mer is in one piece. Of indexed sequences, the index's pieces."""
    if not isinstance(seqs, DataFrame):
        return seqs.pieces(overlap)
    rows = seqs.select("seq_id", F.col("seq").cast("binary").alias("seq")).where("seq is not null")
    at = rows.select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("seq") - 1 - overlap), F.lit(size))).alias("pos0"))
    return at.select("seq_id", F.col("pos0").cast("bigint").alias("pos0"), F.substring("seq", F.col("pos0") + 1, size + overlap).alias("seq"))


def slices(regions: DataFrame, seqs: DataFrame, k: int, keys: list[str], size: int = CHUNK) -> DataFrame:
    """seq_id (a struct of the keys), pos0, seq: the regions (keys, seq_id, start, end) cut from pieces of seqs(seq_id, seq).

    A region's k-mers, those that lie in it whole, are in its slices once each, at their places in the sequence. Regions
    are joined to pieces of `size` bases, so no sequence goes through a join and one of any length is many rows. What
    lies beyond a sequence's ends is left out; regions shorter than k have no slices. Of indexed sequences only the bytes
    that regions touch are read.
    """
    if not isinstance(seqs, DataFrame):
        return seqs.slices(regions, k, keys)
    clear = regions.select(*keys, F.col("seq_id").alias("_of"), F.greatest("start", F.lit(0)).cast("bigint").alias("_a"), F.col("end").cast("bigint").alias("_z")).where(F.col("_z") - F.col("_a") >= k)
    wanted = clear.withColumn("_chunk", F.explode(F.sequence(F.expr(f"_a div {size}L"), F.expr(f"(_z - {k}) div {size}L"))))
    pieces = chunked(seqs, k - 1, size).select(F.col("seq_id").alias("_of"), F.expr(f"pos0 div {size}L").alias("_chunk"), "pos0", "seq")
    low, high = F.greatest("_a", "pos0"), F.least(F.col("_z"), F.col("pos0") + F.length("seq"))
    cut = pieces.join(wanted, ["_of", "_chunk"]).select(F.struct(*keys).alias("seq_id"), low.alias("_low"), F.substring("seq", (low - F.col("pos0") + 1).cast("int"), (high - low).cast("int")).alias("seq"))
    return cut.select("seq_id", F.col("_low").alias("pos0"), "seq").where(F.length("seq") >= k)
