"""Scores of windows against each other: average nucleotide identity from set containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import banded, hopping, tumbling
from ..plans.params import Params
from ..functions.kmers import canonical
from ..sources.folder import safe, write_files
from ..sources.indexed import Indexed, Reader

GROUP = ["seq_id", "band"]
#: Bases whose bands a task multiplies.
BAND_SHARE = 1 << 23


def score(share: Column, k: int) -> Column:
    return F.pow(share, F.lit(1.0) / F.lit(float(k))) * 100


def sizes(plain: DataFrame) -> DataFrame:
    return plain.groupBy(*GROUP, "win").agg(F.count("*").alias("n"))


def intersections(plain: DataFrame, wide: DataFrame) -> DataFrame:
    """seq_id, band, i, j, c: k-mers that plain window i shares with wide window j."""
    a = plain.withColumnRenamed("win", "i")
    b = wide.withColumnRenamed("win", "j")
    return a.join(b, [*GROUP, "kmer"]).groupBy(*GROUP, "i", "j").agg(F.count("*").alias("c"))


def cells(plain: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """seq_id, band, i, j, score for i < j: the better containment of the two, to the power 1/k. Absent: 0.

    The join makes a row for each two windows that share a k-mer; where arrays fill a band use dense_cells.
    """
    n = sizes(plain)
    c = intersections(plain, wide).where("i <> j")
    share = c.join(n.select(*GROUP, F.col("win").alias("i"), "n"), [*GROUP, "i"]).join(n.select(*GROUP, F.col("win").alias("j")), [*GROUP, "j"], "left_semi")
    best = share.groupBy(*GROUP, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max(F.col("c") / F.col("n")).alias("share"))
    return best.select(*GROUP, "i", "j", score(F.col("share"), k).alias("score"))


def _product(plain: tuple[np.ndarray, np.ndarray], wide: tuple[np.ndarray, np.ndarray], rows: int, across: int, columns: int) -> np.ndarray:
    """How many k-mers plain window i shares with wide window j, from distinct (window, k-mer) pairs: products of `columns` k-mers at a time."""
    held = np.intersect1d(plain[1], wide[1])  # other k-mers meet nothing
    columns = max(1, min(columns, len(held)))
    c = np.zeros((rows, across))
    sides = []
    for win, code in (plain, wide):
        at = np.searchsorted(held, code)
        at[at == len(held)] = 0
        keep = held[at] == code if len(held) else np.zeros(len(code), bool)
        order = np.argsort(at[keep], kind="stable")
        sides.append((win[keep][order], at[keep][order]))
    for x in range(0, len(held), columns):
        a, b = np.zeros((rows, columns), np.float32), np.zeros((across, columns), np.float32)
        for m, (win, at) in zip((a, b), sides, strict=True):
            lo, hi = np.searchsorted(at, (x, x + columns))
            m[win[lo:hi], at[lo:hi] - x] = 1
        c += a @ b.T
    return c


def _most(*windows: np.ndarray) -> int:
    """Windows up to the last that holds anything."""
    return max(int(w.max(initial=-1)) for w in windows) + 1


def _scores(plain: tuple[np.ndarray, np.ndarray], wide: tuple[np.ndarray, np.ndarray], k: int, windows: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, score of one band from the distinct (window, k-mer number) pairs of its plain and wide windows."""
    windows = min(windows, _most(plain[0]))  # later ones hold nothing, so have no cells
    n = np.bincount(plain[0], minlength=windows).astype(np.float64)
    c = _product(plain, tuple(x[wide[0] < windows] for x in wide), windows, windows, columns)
    share = np.divide(c, n[:, None], out=np.zeros_like(c), where=n[:, None] > 0)
    share = np.where((n[:, None] > 0) & (n[None, :] > 0), np.maximum(share, share.T), 0)
    i, j = np.nonzero(np.triu(share, 1))
    return i, j, share[i, j] ** (1 / k) * 100


def _by_band(rows: DataFrame, pairs, k: int, windows: int, columns: int) -> DataFrame:
    """Cells of each band's rows; pairs(table) gives _scores' first two arguments."""
    kind = rows.schema["seq_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        i, j, score_ = _scores(*pairs(table), k, windows, columns)
        first = [table.column(g).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(i), np.int64))) for g in GROUP]
        return pa.table([*first, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(score_)], names=[*GROUP, "i", "j", "score"])

    return rows.groupBy(*GROUP).applyInArrow(run, f"seq_id {kind}, band bigint, i int, j int, score double")


def dense_cells(plain: DataFrame, wide: DataFrame, k: int, windows: int, columns: int = 4096) -> DataFrame:
    """The same cells by matrix products in each band.

    A band's k-mers are bounded by its length; its windows are `windows`; `columns` k-mers are multiplied at a time.
    So a k-mer that all windows share costs one column, not a row for each two of them.
    """
    rows = plain.select(*GROUP, "win", "kmer", F.lit(False).alias("wide")).unionByName(wide.select(*GROUP, "win", "kmer", F.lit(True).alias("wide")))

    def pairs(table: pa.Table):
        win, kmer, of_wide = (table.column(c).to_numpy() for c in ("win", "kmer", "wide"))
        return (win[~of_wide], kmer[~of_wide]), (win[of_wide], kmer[of_wide])

    return _by_band(rows, pairs, k, windows, columns)


def _window_pairs(local: np.ndarray, kmer: np.ndarray, p: Params) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The distinct (window, k-mer) pairs of a band's plain and wide windows, from k-mers at places in it."""
    own = local < p.band
    first = np.maximum(0, (local - p.interval) // p.window)
    count = np.minimum(p.windows - 1, (local + p.interval) // p.window) - first + 1
    wide = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    value = kmer.astype(np.int64) + (1 << 31)

    def distinct(win: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(win.astype(np.int64) << 32 | value)  # a number for a pair
        return both >> 32, both & ((1 << 32) - 1)

    return distinct(local[own] // p.window, value[own]), distinct(wide, np.repeat(value, count))


def band_cells(banded_: DataFrame, p: Params, columns: int = 4096) -> DataFrame:
    """The same cells straight from banded positions: the windows are made where the products are, so k-mers are shuffled once."""

    def pairs(table: pa.Table):
        return _window_pairs(table.column("local").to_numpy(), table.column("kmer").to_numpy(), p)

    return _by_band(banded_.select(*GROUP, "local", "kmer"), pairs, p.k, p.windows, columns)


def cross_band(plain: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """seq_id, band, i, j, score: window i of a band against windows j >= i of the band before it."""
    n = sizes(plain)

    def contained(a: DataFrame, b: DataFrame, step: int) -> DataFrame:
        """Shares of plain windows of a (win x) that wide windows of b (win y), `step` bands further, hold."""
        got = a.select("seq_id", F.col("band").alias("ba"), F.col("win").alias("x"), "kmer").join(b.select("seq_id", (F.col("band") - step).alias("ba"), F.col("win").alias("y"), "kmer"), ["seq_id", "ba", "kmer"])
        got = got.where("y >= x" if step < 0 else "x >= y").groupBy("seq_id", "ba", "x", "y").agg(F.count("*").alias("c"))
        return got.join(n.select("seq_id", F.col("band").alias("ba"), F.col("win").alias("x"), "n"), ["seq_id", "ba", "x"]).select("seq_id", "ba", "x", "y", (F.col("c") / F.col("n")).alias("share"))

    later = contained(plain, wide, -1).select("seq_id", F.col("ba").alias("band"), F.col("x").alias("i"), F.col("y").alias("j"), "share")
    earlier = contained(plain, wide, 1).select("seq_id", (F.col("ba") + 1).alias("band"), F.col("y").alias("i"), F.col("x").alias("j"), "share")
    both = later.unionByName(earlier).groupBy("seq_id", "band", "i", "j").agg(F.max("share").alias("share"))
    own = n.select("seq_id", "band", F.col("win").alias("i"))
    before = n.select("seq_id", (F.col("band") + 1).alias("band"), F.col("win").alias("j"))
    return both.join(own, ["seq_id", "band", "i"], "left_semi").join(before, ["seq_id", "band", "j"], "left_semi").select("seq_id", "band", "i", "j", score(F.col("share"), k).alias("score"))


def indexed_cells(seqs: Indexed, p: Params, least: float = 0.0, columns: int = 4096) -> DataFrame:
    """The same cells of indexed sequences, those of `least` and more: a task reads a band's bases, and hashes and multiplies them. No k-mer is shuffled."""
    rows = seqs.stretches(p.band, p.interval + p.k - 1, BAND_SHARE)
    kind = rows.schema["seq_id"].dataType.simpleString()

    def run(batches):
        reader = Reader()
        for b in batches:
            bands, held, size = b.column("n").to_pylist(), [], 0
            for x, values in hashed(reader, list(zip(*(b.column(c).to_pylist() for c in ("path", "kind", "at", "skip", "size", "bases", "low", "high")), strict=True))):
                values = values[: p.band + p.interval]
                local = np.nonzero((values & 3 == 0) & (values != 0))[0]
                i, j, found = _scores(*_window_pairs(local, values[local], p), p.k, p.windows, columns)
                keep = found >= least
                held.append((np.full(int(keep.sum()), x), i[keep], j[keep], found[keep]))
                size += len(held[-1][0])
                if size >= 1 << 16:
                    yield batch(b, bands, held)
                    held, size = [], 0
            if size:
                yield batch(b, bands, held)
        reader.close()

    def hashed(reader, places):
        """Each band's k-mers; short bands are hashed together."""
        x = 0
        while x < len(places):
            read, total = [], 0
            while x + len(read) < len(places) and (not read or total < 1 << 20):
                read.append(reader.bases(*places[x + len(read)]))
                total += len(read[-1])
            values, at = canonical(b"".join(read), p.k), 0
            for seq in read:
                yield x, values[at : max(at, at + len(seq) - p.k + 1)]
                x, at = x + 1, at + len(seq)

    def batch(b, bands, held):
        x, i, j, found = map(np.concatenate, zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([b.column("seq_id").take(pa.array(x)), pa.array(np.array(bands, np.int64)[x]), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(found)], [*GROUP, "i", "j", "score"])

    return rows.mapInArrow(run, f"seq_id {kind}, band bigint, i int, j int, score double")


def _by_sets(rows: DataFrame, of, out: str) -> DataFrame:
    """Rows (i, j, value) that of(sets) makes of each band's distinct (window, k-mer) pairs, by what their rows say (kind)."""
    kind = rows.schema["seq_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        win, kmer, which = (table.column(c).to_numpy() for c in ("win", "kmer", "kind"))
        i, j, value = of([(win[which == x], kmer[which == x]) for x in range(4)])
        first = [table.column(g).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(i), np.int64))) for g in GROUP]
        return pa.table([*first, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(value)], names=[*GROUP, "i", "j", out.split()[0]])

    return rows.groupBy(*GROUP).applyInArrow(run, f"seq_id {kind}, band bigint, i int, j int, {out}")


def _kinded(df: DataFrame, band, kind: int) -> DataFrame:
    return df.select("seq_id", band.cast("bigint").alias("band"), "win", "kmer", F.lit(kind).alias("kind"))


def dense_intersections(plain: DataFrame, wide: DataFrame, columns: int = 4096) -> DataFrame:
    """The rows of intersections() by matrix products in each band: a k-mer that all windows share is a column, not a row for each two of them."""
    rows = _kinded(plain, F.col("band"), 0).unionByName(_kinded(wide, F.col("band"), 1))

    def of(sets):
        c = _product(sets[0], sets[1], _most(sets[0][0]), _most(sets[1][0]), columns)
        i, j = np.nonzero(c)
        return i, j, c[i, j].astype(np.int64)

    return _by_sets(rows, of, "c bigint")


def dense_cross_band(plain: DataFrame, wide: DataFrame, k: int, columns: int = 4096) -> DataFrame:
    """The rows of cross_band() by two matrix products for each band and the one before it.

    A band's k-mers go to two groups, its own and the next band's; a group is two bands, whatever their k-mers share.
    """
    before = F.col("band") + 1
    rows = _kinded(plain, F.col("band"), 0).unionByName(_kinded(wide, F.col("band"), 1)).unionByName(_kinded(plain, before, 2)).unionByName(_kinded(wide, before, 3))

    def of(sets):
        own, own_wide, old, old_wide = sets
        rows_, across = _most(own[0], own_wide[0]), _most(old[0], old_wide[0])
        n, m = np.bincount(own[0], minlength=rows_), np.bincount(old[0], minlength=across)
        part = lambda c, size: np.divide(c, size, out=np.zeros_like(c), where=size > 0)
        share = np.maximum(part(_product(own, old_wide, rows_, across, columns), n[:, None]), part(_product(old, own_wide, across, rows_, columns), m[:, None]).T)
        i, j = np.nonzero(np.triu(share * ((n > 0)[:, None] & (m > 0)[None, :])))
        return i, j, share[i, j] ** (1 / k) * 100

    return _by_sets(rows, of, "score double")


def images(cells: DataFrame, windows: int, least: float = 86.0) -> DataFrame:
    """seq_id, band, image: each band's matrix as a gray picture (PGM), `least` and below white, 100 black."""
    kind = cells.schema["seq_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        gray = np.full((windows, windows), 255, np.uint8)
        np.fill_diagonal(gray, 0)
        i, j, score_ = (table.column(c).to_numpy() for c in ("i", "j", "score"))
        gray[i, j] = gray[j, i] = np.round(255 * (100 - np.clip(score_, least, 100)) / (100 - least)).astype(np.uint8)
        first = [table.column(g).slice(0, 1) for g in GROUP]
        return pa.table([*first, pa.array([f"P5 {windows} {windows} 255\n".encode() + gray.tobytes()], pa.binary())], names=[*GROUP, "image"])

    return cells.select(*GROUP, "i", "j", "score").groupBy(*GROUP).applyInArrow(run, f"seq_id {kind}, band bigint, image binary")


def write_images(pictures: DataFrame, path: str) -> None:
    """images' rows as files {seq_id}.{band}.pgm of a folder, by the tasks that have them."""

    def contents(batches):
        for b in batches:
            for seq_id, band, image in zip(*(b.column(c).to_pylist() for c in (*GROUP, "image")), strict=True):
                yield f"{safe(None if seq_id is None else str(seq_id))}.{band}.pgm", image

    write_files(pictures, GROUP, [], contents, path, ".pgm")


def matrix(cells: DataFrame, seq_id, band: int, windows: int) -> np.ndarray:
    """One band's whole matrix, for a plot: 100 on the diagonal, 0 where there is no cell. windows^2 numbers reach the driver."""
    out = np.eye(windows) * 100
    for r in cells.where((F.col("seq_id") == seq_id) & (F.col("band") == band)).select("i", "j", "score").collect():
        out[r.i, r.j] = out[r.j, r.i] = r.score
    return out


def window_sets(kmers: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    b = banded(kmers, p)
    return tumbling(b, p), hopping(b, p)
