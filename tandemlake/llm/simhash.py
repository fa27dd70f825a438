"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 bits are dealt to the 2^(r+1) - 1 nonzero vectors of r+1 bits. For each such vector v a table masks
the bits whose vector has an even inner product with v out of the fingerprint (bits with an odd one stay). The
vectors of up to r differing bits leave some v to which all are orthogonal, so two fingerprints within r bits are
equal under that table's mask: every pair within the radius meets in some table.

Only distinct fingerprints are looked at, so copies cost nothing. A bucket of two is compared at once. From a larger
bucket come no pairs but the links that join its parts, fewer than it has members. Fingerprints x and y are within 2
bits if and only if some z is within 1 bit of both, so each member names the z's that differ from it in at most one of
the table's masked-out bits; at most 65 fingerprints can share a z. Buckets too large for a task are dealt out by z.
Components are found by alternating star steps over fingerprints.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, cut, empty_if_null, ids_and_text, map_batches, utf8, with_row, without_rows
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
STEP, LOCAL = 1 << 15, 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text in UTF-8: a bit is set if it is in over half the hashes of its word shingles."""
    w = text.lower().split()  # bytes: lowers A-Z, splits at \x20 and \x09-\x0D only
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), STEP):
        ones += np.unpackbits(raw[i : i + STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id and fp (bigint with the fingerprint's 64 bits) of each row; of rows named by column `row`, also row and sha (of the text). Null and empty texts: 0."""

    def f(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            raw, at = data.tobytes(), at.tolist()
            fp = np.fromiter((fingerprint(raw[x:y], words, seed) for x, y in zip(at, at[1:], strict=False)), np.uint64, b.num_rows)
            own = [b.column("row"), pa.array([hashlib.sha256(raw[x:y]).digest() for x, y in zip(at, at[1:], strict=False)], pa.binary())] if row else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), *own], ["doc_id", "fp", "row", "sha"][: 2 + len(own)])

    rows = ids_and_text(docs) if row is None else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), empty_if_null("text"), F.col(row).alias("row"))
    return cut(map_batches(rows, f, "doc_id bigint, fp bigint" + f", row {ROW}, sha binary" * bool(row)))


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' masks: bit i belongs to vector i % (2^(r+1) - 1) + 1; a mask has the bits whose vector is odd with v."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if (i % n + 1 & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joined(g: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in one bucket: each member of g (distinct, sorted) that isn't the first of its part, with that first."""
    n = len(g)
    if n <= 64:
        u = g.view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
        i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= RADIUS, 1))
    else:
        z = (g[:, None] ^ flips[None, :]).ravel()
        order = np.argsort(z, kind="stable")
        z, member = z[order], order // len(flips)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], z[1:] != z[:-1]]), np.arange(len(z)), 0))
        i, j = member[first], member
        i, j = i[i != j], j[i != j]
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return g[label[moved]], g[moved]


def links(fps: DataFrame, local: int = LOCAL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within RADIUS (2) bits, enough of them to join all that are linked.

    Buckets of up to `local` fingerprints (8 bytes each) are joined in one task; larger ones are dealt out by z. Both ways
    join the same fingerprints, so `local` bounds a task's memory and changes no result.
    """
    tables = masks(RADIUS)
    flip = [[0, *(signed(1 << i) for i in range(64) if not m >> i & 1)] for m in tables]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in tables])).alias("t", "key"))
    buckets = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    crowded = cut(keyed.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"]).select("t", "key", "n", "fp"))

    def in_bucket(batches):
        rest = None
        for b in batches:
            new = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in ("t", "key", "fp")])
            rows = new if rest is None else np.concatenate([rest, new], axis=1)
            limits = np.concatenate([[0], np.nonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))[0] + 1])
            yield of_groups(rows[:, : limits[-1]], limits)
            rest = rows[:, limits[-1] :]
        if rest is not None:
            yield of_groups(rest, np.array([0, rest.shape[1]]))

    def of_groups(rows, limits):
        got = [joined(rows[2, x:z], np.array(flip[rows[0, x]])) for x, z in zip(limits.tolist(), limits[1:].tolist(), strict=False)]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(g[k] for g in got)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    near = map_batches(crowded.where(F.col("n") <= local).select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp"), in_bucket, "a bigint, b bigint")
    found = pairs.unionByName(near)
    if crowded.where(F.col("n") > local).isEmpty():
        return found
    flips = F.array(*[F.array(*map(F.lit, f)) for f in flip])
    spread = crowded.where(F.col("n") > local).select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z")).distinct()
    shared = spread.groupBy("z").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 are within a bit of z
    return found.unionByName(shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))


def _named(rows: DataFrame) -> DataFrame:
    """fp, root, component_id (the least doc_id of the component) of each distinct fingerprint of rows (doc_id, fp)."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(links(fps)))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # so that the join stands on exchanges of its own
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links, itself included).

    Rows with a null doc_id take part in links; component_id is null only where a component has no doc_id at all.
    Repeated doc_ids give a row each. Other columns are ignored. Texts of any length are read whole. No rows give no rows.
    """
    rows = fingerprints(docs)
    return rows.join(_named(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, stored: bool = False) -> DataFrame:
    """One row of each component, with all columns of docs: that of the smallest doc_id, of several the least text hash.

    Rows are told apart by where they stand (see with_row, also on `stored`), so a null or repeated doc_id takes no other
    row with it; a null doc_id counts as larger than any other. Of rows equal in doc_id and text, the first in place
    stays, whatever its other columns hold. Null texts count as empty. No rows give no rows.
    """
    docs, name = with_row(docs, stored)
    rows = fingerprints(docs, row=name)
    found = cut(rows.join(_named(rows).select("fp", "root"), "fp").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "row").alias("own")))
    best = cut(found.groupBy("root").agg(F.min("own").alias("best")))
    return without_rows(docs, name, found.join(best, "root").where("own <> best").select("own.row.*"))
