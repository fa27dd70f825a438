"""Refinement of span ends: how far outward the core's k-mers are still found.

A span's core is its middle without a margin of 1.5 windows on either side. The zone around an end is cut into chunks
of about 100 bases; a chunk is a hit if it shares more distinct k-mers with the core than a quarter of the number of
chunks. Outward from the core, the last hit before ten misses in a row holds the end, which is set to the base where
the core's k-mers begin or stop. If no chunk is a hit, a zone further inside is tried; if that fails too, the end stays.

A core may be as long as an array, so it is hashed piece by piece and joined, k-mer by k-mer, to the zones, which are a
few windows. Only a span's zones meet in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .whole import distinct, member, table, unsigned
from ..functions.kmers import CHUNK as PIECE
from ..functions.kmers import canonical, kmers, slices

CHUNK, MISSES = 100, 10


def chunk_counts(values: np.ndarray, core: np.ndarray, n: int) -> np.ndarray:
    """Distinct k-mers that each of n equal chunks shares with the core."""
    length = max(1, math.ceil(len(values) / n))
    held = np.isin(values, core)
    pairs = distinct(np.nonzero(held)[0] // length << 32 | unsigned(values[held]))
    return np.bincount(pairs >> 32, minlength=n)[:n]


def last_hit(hits: np.ndarray, misses: int = MISSES) -> int | None:
    """In scan order, the last hit before `misses` misses in a row; None without one."""
    at, last = -1, None
    for i in np.nonzero(hits)[0].tolist():
        if i - at > misses:
            break
        at = last = i
    return last


def last_match(values: np.ndarray, core: np.ndarray, lo: int, hi: int) -> int:
    """The largest index in [lo, hi) whose k-mer is in the core; lo if there is none or if hi is beyond the list."""
    if hi > len(values):
        return lo
    found = np.nonzero(np.isin(values[lo:hi], core))[0]
    return lo + int(found[-1]) if len(found) else lo


def end_in_zone(values: np.ndarray, core: np.ndarray, left: bool, compat: bool = False) -> int | None:
    """Where, in a zone's k-mers, the core's begin (left) or stop. compat takes the last match of two chunks on either side."""
    if not len(values):
        return None
    n = max(1, math.ceil(len(values) / CHUNK))
    counts = chunk_counts(values, core, n)
    hits = counts > math.ceil(n / 4)
    found = last_hit(hits[::-1] if left else hits)
    if found is None:
        return None
    length = math.ceil(len(values) / n)
    chunk = n - 1 - found if left else found
    if compat:
        lo = CHUNK * (max(0, chunk - 1) if left else chunk)
        return last_match(values, core, lo, lo + 2 * CHUNK)
    lo, hi = max(0, (chunk - 1) * length), min(len(values), (chunk + 2) * length)  # the array may begin inside the neighbour
    match = np.nonzero(np.isin(values[lo:hi], core))[0]
    return lo + int(match[0] if left else match[-1])


def zones(start, end, w, h) -> dict[str, tuple]:
    """The stretches that are read around a span, by name: core, left and right end, and where to look if that fails."""
    return {"core": (start + w + h, end - w - h), "left": (start - w - h, start + w + h), "left2": (start + w, start + w + 5 * h), "right": (end - w - h, end + w + h), "right2": (end - w - 5 * h, end - w)}


def ends(parts: dict[str, tuple[int, np.ndarray, np.ndarray]], k: int, compat: bool = False) -> tuple[int, int] | None:
    """A span's new start and end from its zones' first positions, k-mers, and those that the core holds; None if either isn't found.

    compat moves the start by k, as it moves the end, and counts a zone at base 0 from the base after it.
    """

    def found(name: str, left: bool) -> int | None:
        first, values, core = parts.get(name, (0, np.zeros(0, np.int32), np.zeros(0, np.int32)))
        at = end_in_zone(values[int(compat and first == 0) :], core, left, compat)
        return None if at is None else first + at

    start, shift = found("left", True), -k
    if start is None:
        start, shift = found("left2", True), k
    end = found("right", False)
    if end is None:
        end = found("right2", False)
    if start is None or end is None:
        return None
    start, end = start + shift * compat, end + k
    return (start, end) if start < end else None


def refined(spans: DataFrame, seqs: DataFrame, window: int, k: int, compat: bool = False) -> DataFrame:
    """seq_id, start, end, raw_start, raw_end, refined: spans with new ends where both were found, and as they were elsewhere."""
    if isinstance(seqs, DataFrame):
        return _refined_whole(spans, seqs, window, k, compat)
    keys = ["seq_id", "start", "end"]
    size = F.col("end") - F.col("start")
    w = F.when(size >= 4 * window, window).otherwise(F.greatest(F.lit(1), F.expr("(end - start) div 4"))).cast("bigint")
    sized = spans.select(*keys).distinct().withColumn("w", w).withColumn("h", F.ceil(F.col("w") / 2))
    stretches = F.array(*[F.struct(F.lit(n).alias("zone"), a.alias("a"), z.alias("z")) for n, (a, z) in zones(*map(F.col, ("start", "end", "w", "h"))).items()])
    each = sized.select(F.struct(*keys).alias("span"), "seq_id", F.explode(stretches).alias("x")).select("span", "seq_id", F.col("x.zone").alias("zone"), F.col("x.a").alias("start"), F.col("x.z").alias("end"))
    hashed = lambda rows, distinct: kmers(slices(rows, seqs, k, ["span", "zone"]), k, distinct=distinct).select("seq_id.span", "seq_id.zone", "pos", "kmer")
    core = hashed(each.where("zone = 'core'"), True).where(F.lit(compat) | (F.col("kmer") != 0)).select("span", "kmer").distinct().withColumn("held", F.lit(True))
    around = hashed(each.where("zone <> 'core'"), False).join(core, ["span", "kmer"], "left").select("span", "zone", "pos", "kmer", F.coalesce("held", F.lit(False)).alias("held"))
    kind = spans.schema["seq_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        zone, pos, kmer, held = (table.column(c).to_numpy() for c in ("zone", "pos", "kmer", "held"))
        parts = {}
        for name in np.unique(zone):
            mine = np.nonzero(zone == name)[0]
            mine = mine[np.argsort(pos[mine])]
            parts[name] = int(pos[mine[0]]), kmer[mine], np.unique(kmer[mine][held[mine]])
        got = ends(parts, k, compat)
        span = table.column("span").slice(0, 1 if got else 0)
        return pa.table([span, pa.array([x for x in (got or ())[:1]], pa.int64()), pa.array([x for x in (got or ())[1:]], pa.int64())], names=["span", "new_start", "new_end"])

    new = around.groupBy("span").applyInArrow(run, f"span struct<seq_id:{kind},start:bigint,end:bigint>, new_start bigint, new_end bigint")
    found = new.select("span.*", "new_start", "new_end")
    return spans.select(*keys).join(found, keys, "left").select("seq_id", F.coalesce("new_start", "start").alias("start"), F.coalesce("new_end", "end").alias("end"), F.col("start").alias("raw_start"), F.col("end").alias("raw_end"), F.col("new_start").isNotNull().alias("refined"))


def _refined_whole(spans: DataFrame, seqs: DataFrame, window: int, k: int, compat: bool) -> DataFrame:
    """The same where sequences are rows: spans go to their sequence, and no k-mer is shuffled."""
    kind = spans.schema["seq_id"].dataType.simpleString()
    none, long = F.lit(None), lambda c: c.cast("bigint")
    given = spans.select("seq_id", F.lit(True).alias("asked"), long(F.col("start")).alias("start"), long(F.col("end")).alias("end"), none.cast("binary").alias("seq"))
    bases = seqs.select(F.col("seq_id").cast(kind).alias("seq_id"), F.lit(False).alias("asked"), long(none).alias("start"), long(none).alias("end"), F.col("seq").cast("binary").alias("seq"))
    rows = bases.unionByName(given).repartition("seq_id").sortWithinPartitions("seq_id", "asked", "start", "end")

    def run(batches):
        now, held, last, got = None, [], None, None
        for b in batches:
            out = []
            for x, (seq_id, asked, start, end, seq) in enumerate(zip(*(b.column(c).to_pylist() for c in ("seq_id", "asked", "start", "end", "seq")), strict=True)):
                if seq_id != now:
                    now, held, last = seq_id, [], None
                if not asked:
                    if seq is not None and seq_id is not None:
                        held.append(_Bases(seq, k))
                    continue
                if (start, end) != last:
                    last, got = (start, end), None if start is None or end is None else _new_ends(held, start, end, window, k, compat)
                out.append((x, *(got or last), *last, got is not None))
            if out:
                at, *columns = zip(*out, strict=True)
                types = [pa.int64()] * 4 + [pa.bool_()]
                yield from table(b.column("seq_id"), np.array(at), **{name: pa.array(c, t) for name, c, t in zip(("start", "end", "raw_start", "raw_end", "refined"), columns, types, strict=True)})

    return rows.mapInArrow(run, f"seq_id {kind}, start bigint, end bigint, raw_start bigint, raw_end bigint, refined boolean")


class _Bases:
    """k-mers of parts of a sequence. One of a piece or less is hashed once."""

    def __init__(self, seq: bytes, k: int):
        self.seq, self.k, self.values = seq, k, None

    def hashed(self, a: int, z: int) -> np.ndarray:
        """Those that lie whole in [a, z), where a is 0 or more."""
        if len(self.seq) > PIECE:
            return canonical(self.seq[a : max(a, z)], self.k)
        if self.values is None:
            self.values = canonical(self.seq, self.k)
        return self.values[a : max(a, z - self.k + 1)]


def _new_ends(held: list[_Bases], start: int, end: int, window: int, k: int, compat: bool) -> tuple[int, int] | None:
    """A span's ends from the rows of its sequence. The core is gone through piece by piece."""
    size = end - start
    w = window if size >= 4 * window else max(1, size // 4)
    at = zones(start, end, w, -(-w // 2))
    kmers_of, first, core = {}, {}, at.pop("core")
    for name, (a, z) in at.items():
        a = max(a, 0)
        found = [(np.arange(a, a + len(v)), v) for v in (x.hashed(a, z) for x in held) if z - a >= k and len(v)]
        if found:
            pos, values = map(np.concatenate, zip(*found, strict=True))
            if len(found) > 1:
                order = np.argsort(pos, kind="stable")
                pos, values = pos[order], values[order]
            first[name], kmers_of[name] = int(pos[0]), values
    inside = {name: np.zeros(len(values), bool) for name, values in kmers_of.items()}
    a, z = max(core[0], 0), core[1]
    for x in held if z - a >= k else []:
        for low in range(a, min(z, len(x.seq)) - k + 1, PIECE):
            known = distinct(x.hashed(low, min(z, low + PIECE + k - 1)))
            for name, values in kmers_of.items():
                inside[name] |= member(values, known)
    parts = {name: (first[name], values, np.unique(values[inside[name] & (compat | (values != 0))])) for name, values in kmers_of.items()}
    return ends(parts, k, compat)


def shared_counts(zone_kmers: DataFrame, core: DataFrame, length: int = CHUNK) -> DataFrame:
    """seq_id, chunk, shared: the distinct core k-mers of each chunk of `length` positions."""
    held = zone_kmers.where("kmer <> 0").join(core.select("seq_id", "kmer").distinct(), ["seq_id", "kmer"], "left_semi")
    return held.select("seq_id", F.expr(f"pos div {length}L").alias("chunk"), "kmer").distinct().groupBy("seq_id", "chunk").agg(F.count("*").alias("shared"))


def span_counts(spans: DataFrame, seqs: DataFrame, k: int, length: int = CHUNK) -> DataFrame:
    """seq_id (struct of the span), chunk, shared: for chunks around each span, a third of its size on either side, the distinct k-mers of its middle third."""
    keys, third = ["seq_id", "start", "end"], F.expr("(end - start) div 3")
    at = lambda a, z: spans.select(F.struct(*keys).alias("span"), "seq_id", a.cast("bigint").alias("start"), z.cast("bigint").alias("end"))
    hashed = lambda rows: kmers(slices(rows, seqs, k, ["span"]), k).select("seq_id.span", "pos", "kmer")
    core = hashed(at(F.col("start") + third, F.col("end") - third))
    zone = hashed(at(F.greatest(F.lit(0), F.col("start") - third), F.col("end") + third))
    return shared_counts(zone.withColumnRenamed("span", "seq_id"), core.withColumnRenamed("span", "seq_id"), length)


def scaled_counts(counts: DataFrame, height: int = 10) -> DataFrame:
    """counts with bar: each chunk's shared k-mers as lines of a plot whose highest bar, of its sequence, has `height`."""
    most = F.max("shared").over(Window.partitionBy("seq_id"))
    return counts.withColumn("bar", F.ceil(F.col("shared") * height / most).cast("int"))


def bars(heights: dict[int, int], height: int = 10) -> str:
    """A text plot of chunks' bars, from the first chunk to the last."""
    if not heights:
        return ""
    at = range(min(heights), max(heights) + 1)
    lines = ["".join("#" if heights.get(i, 0) >= level else " " for i in at).rstrip() for level in range(height, 0, -1)]
    return "\n".join([*lines, "-" * len(at)])
