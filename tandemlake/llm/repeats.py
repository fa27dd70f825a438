"""Repeated passages by suffix sorting with hashed comparisons.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier: in a smaller doc_id, or before it in
its own document. Such strings are prefixes of suffixes; where suffixes are sorted, equal ones stand together, the
earliest first. Prefix polynomial hashes of the text tell in constant time whether two stretches are equal, so a
binary search finds how far two suffixes agree, and a mergesort needs logarithmically many steps for a comparison. Each
sorted list is then checked byte by byte, neighbour by neighbour, and sorted by its bytes if a hash has lied.

No task has to hold the corpus's suffixes, because strings that can be equal are brought together first. Each string's
anchor is the place of its least-hashed stretch of PART bytes (the first, of equal ones): equal strings have it at the same
offset with the same hash. A document falls into windows, maximal runs of strings with one anchor, of 35 on average.

1. Windows are compared whole, by their anchor's hash and a hash of their text: the first of equal ones in a task goes on,
   the others are repeats wherever it came from, so however many copies a window has, a task sends one. What Spark's
   shuffle by anchor then finds equal is a repeat of the earliest. A window whose anchor no other window has is done.
2. Windows that share an anchor but not their text, those at the edges of repeated passages, are fetched, and
   their suffixes sorted, among those with equal anchor and equal offset to it. Anchors with more than CROWD such windows
   are dealt out string by string instead, by a 128-bit digest; this changes no result.
3. What was found is written in pages by document and read where the documents are read again: no text is shuffled
   but that of step 2.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, empty_if_null, map_batches, utf8, written
from .pages import Pages, write_pages

LENGTH = 100
#: Bytes that are hashed at a time, and windows (or strings) that a task compares before it sends the first ones on.
PIECE, CHUNK = 1 << 20, 1 << 20
#: Windows of one anchor that a task sorts, and strings it sorts at a time.
CROWD, BLOCK = 1 << 13, 400_000
#: The polynomial's base (odd, so that it has an inverse modulo 2^64) and the mixer's factor.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LAST = (1 << 63) - 1
ROW_BITS = 36  # of a row's number, the place in its file; the file's number stands above

u64 = np.uint64


def part(length: int) -> int:
    """Bytes of an anchor in strings of `length`."""
    return max(1, length // 3)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * u64(pow(base, done, 1 << 64))
        done += more
    return out


class Prefixes:
    """Hashes of all prefixes of some bytes: a stretch's hash is a difference, divided by the power it starts at."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(12, int(len(data)).bit_length())
        self.inverse = _powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + u64(1)) * _powers(BASE, n)[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def common(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """How many bytes, up to `most`, the suffixes at x and y share, by binary search."""
        n = np.zeros(len(x), np.int64)
        step = 1 << most.bit_length() - 1
        while step:
            end = np.minimum(n + step, most)
            n = np.where(self.of(x + n, x + end) == self.of(y + n, y + end), end, n)
            step >>= 1
        return n


def windows(data: np.ndarray, limits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, strings, anchor's offset and anchor's hash of each window of the texts that `limits` cut data into.

    Bytes are gone through PIECE at a time; a piece's end is a window's end, which costs a comparison and no result.
    """
    q = part(length)
    wide = length - q + 1
    out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
    for first in range(0, len(data) - length + 1, PIECE):
        some = data[first : first + PIECE + length - 1]
        n = len(some) - q + 1
        h = Prefixes(some).of(np.arange(n), np.arange(q, q + n))
        h ^= h >> u64(32)
        h *= u64(MIX)
        h ^= h >> u64(29)
        best = h >> u64(24) << u64(24) | np.arange(n, dtype=np.uint64)  # PIECE + length < 2^24; of equal hashes the first
        span = 1
        while span * 2 <= wide:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < wide:
            best = np.minimum(best[: len(best) - (wide - span)], best[wide - span :])
        anchor = (best & u64((1 << 24) - 1)).astype(np.int64)
        texts = slice(int(np.searchsorted(limits, first, "right")), int(np.searchsorted(limits, first + len(anchor), "left")) + 1)  # by their ends
        text = np.repeat(limits[texts], np.diff(np.clip(limits[texts.start - 1 : texts.stop], first, first + len(anchor))))  # each string's text's end
        whole = np.arange(first + length, first + length + len(anchor)) <= text
        begins = whole.copy()
        begins[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        ends = whole.copy()
        ends[:-1] &= begins[1:] | ~whole[1:]
        start, end = np.nonzero(begins)[0], np.nonzero(ends)[0]
        out.append([start + first, end - start + 1, anchor[start] - start, h[anchor[start]]])
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def place_of(start: np.ndarray, strings: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A window in a number: start in its text, its anchor's offset, its strings less one."""
    return start << 32 | offset << 16 | strings - 1


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, strings, offset."""
    return place >> 32, (place & 0xFFFF) + 1, place >> 16 & 0xFFFF


def merged(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of texts, those that touch or overlap joined, in order."""
    order = np.lexsort((end, start, uid))
    uid, start, end = uid[order], start[order], end[order]
    if not len(uid):
        return uid, start, end
    _, code = np.unique(uid, return_inverse=True)
    reach = np.maximum.accumulate(end + (code << 33)) - (code << 33)  # within a text; a text is under 2^32 bytes
    new = np.concatenate([[True], (uid[1:] != uid[:-1]) | (start[1:] > reach[:-1])])
    first = np.nonzero(new)[0]
    return uid[first], start[first], np.maximum.reduceat(end, first)


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, prefixes: Prefixes | None = None) -> np.ndarray:
    """The order of `at` (grouped: equal `group`s adjacent) by the `length` bytes that follow, equal ones as they stand, in each group.

    A mergesort from the bottom up, of all groups at once; a run's element finds its place in the run beside it by binary search.
    """
    prefixes = prefixes or Prefixes(data)
    n = len(at)
    new = np.concatenate([[True], group[1:] != group[:-1]])[:n]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    sizes = np.diff(np.append(np.nonzero(new)[0], n))
    size, order, width = np.repeat(sizes, sizes), np.arange(n), 1
    while width < sizes.max(initial=0):
        slot = np.nonzero(size > width)[0]
        mine, home = order[slot], begin[slot]
        run = (slot - home) // width
        low = home + (run ^ 1) * width
        there = low < home + size[slot]  # else the last run stands alone
        slot, mine, home, run, low = slot[there], mine[there], home[there], run[there], low[there]
        a, z = low.copy(), np.minimum(low + width, home + size[slot])
        while (open_ := np.nonzero(a < z)[0]).size:
            mid = (a[open_] + z[open_]) // 2
            x, y = at[mine[open_]], at[order[mid]]
            same = prefixes.common(x, y, length)
            tie = same == length
            same[tie] = 0
            less = np.where(tie, run[open_] % 2 == 1, data[y + same] < data[x + same])  # whether mid's goes before mine
            a[open_] = np.where(less, mid + 1, a[open_])
            z[open_] = np.where(less, z[open_], mid)
        moved = order.copy()
        moved[home + np.minimum(run, run ^ 1) * width + (slot - home - run * width) + (a - low)] = mine
        order = moved
        width *= 2
    return order


def repeats(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of `at` (grouped, and in order of precedence within a group) start a string that one before them in the group also starts."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    order = suffix_order(data, at, group, length)
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    equal = np.zeros(len(at), bool)
    right = True
    for i in range(0, len(at) - 1, 1 << 16):  # collisions: neighbours are compared byte by byte
        j = min(i + (1 << 16), len(at) - 1)
        x, y = order[i:j], order[i + 1 : j + 1]
        pair = group[x] == group[y]
        a, b = rows[at[x[pair]]], rows[at[y[pair]]]
        differ = a != b
        first = differ.argmax(axis=1)[:, None]
        no = differ.any(axis=1)
        right &= bool((np.take_along_axis(a, first, 1) < np.take_along_axis(b, first, 1))[no, 0].all() and (x[pair] < y[pair])[~no].all())
        equal[i + 1 : j + 1][pair] = ~no
    if not right:
        order = np.array(sorted(range(len(at)), key=lambda i: (group[i], rows[at[i]].tobytes(), i)))
        equal[1:] = [group[x] == group[y] and (rows[at[x]] == rows[at[y]]).all() for x, y in zip(order, order[1:], strict=False)]
    out[order] = equal
    return out


FIRST, SETTLED, COVER, WINDOW = range(4)
SENT = ["key", "kind", "w", "doc", "uid", "place"]
SENT_TYPE = "key bigint, kind bigint, w bigint, doc bigint, uid bigint, place bigint"


def _sent(*parts: tuple) -> pa.RecordBatch:
    columns = [np.concatenate([np.broadcast_to(np.asarray(p[i]), p[4].shape).astype(np.int64) for p in parts]) for i in range(6)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), SENT)


def _covers(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    """Stretches as rows that pass through the shuffle, evenly dealt."""
    uid, start, end = merged(uid, start, end)
    return _spread(uid, start), COVER, end, 0, uid, start


def _spread(uid: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((uid ^ place).astype(np.uint64) * u64(MIX)).astype(np.int64)


def _firsts(key: np.ndarray, w: np.ndarray, doc: np.ndarray, uid: np.ndarray, place: np.ndarray, by_key: bool, length: int) -> pa.RecordBatch:
    """What a task sends of the windows (or, without by_key, strings) it has seen: of equal ones the first, and stretches for the others.

    by_key: windows of a key that has several texts here are sent as WINDOW, to be fetched whatever other tasks have; two of
    them go to the key as SETTLED, so that windows of other tasks see them.
    """
    order = np.lexsort((place, uid, doc, w, key))
    key, w, doc, uid, place = (x[order] for x in (key, w, doc, uid, place))
    same_key = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
    first = ~(same_key & np.concatenate([[False], w[1:] == w[:-1]])[: len(key)])
    start, strings, _ = unplaced(place)
    rest = _covers(uid[~first], start[~first], (start + strings - 1 + length)[~first])
    key, w, doc, uid, place, same_key = (x[first] for x in (key, w, doc, uid, place, same_key))
    several = np.zeros(len(key), bool)
    if by_key:
        several = same_key | np.concatenate([same_key[1:], [False]])[: len(key)]
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(same_key, 0, np.arange(len(key))))
    told = several & (rank < 2)
    return _sent(
        (key[~several], FIRST, w[~several], doc[~several], uid[~several], place[~several]),
        (key[told], SETTLED, w[told], doc[told], uid[told], place[told]),
        (_spread(uid[several], place[several]), WINDOW, key[several], doc[several], uid[several], place[several]),
        rest,
    )


def _compared(rows: DataFrame, by_key: bool, length: int) -> DataFrame:
    """kind (COVER or WINDOW), uid, a, z from what tasks sent: of a cover its stretch, of a window its place and key."""

    def settled(r: np.ndarray) -> pa.RecordBatch:
        passed = r[:, r[1] >= COVER]
        r = r[:, r[1] < COVER]
        key, kind, w, _, uid, place = r
        same_key = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
        first = ~(same_key & np.concatenate([[False], w[1:] == w[:-1]])[: len(key)])
        again = ~first & (kind == FIRST)
        start, strings, _ = unplaced(place[again])
        u, a, z = merged(uid[again], start, start + strings - 1 + length)
        group = np.cumsum(~same_key) - 1
        texts = np.bincount(group[first], minlength=1 + (group[-1] if len(group) else 0))
        open_ = first & (kind == FIRST) & (texts[group] > 1) if by_key else np.zeros(len(key), bool)
        cover, window = passed[:, passed[1] == COVER], passed[:, passed[1] == WINDOW]
        parts = [(COVER, u, a, z), (COVER, cover[4], cover[5], cover[2]), (WINDOW, window[4], window[5], window[2]), (WINDOW, uid[open_], place[open_], key[open_])]
        columns = [np.concatenate([np.broadcast_to(np.asarray(p[i]), p[1].shape) for p in parts]) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["kind", "uid", "a", "z"])

    def run(batches):
        held = np.zeros((6, 0), np.int64)
        for b in batches:
            held = np.concatenate([held, np.stack([np.asarray(b.column(c)) for c in SENT])], axis=1)
            last = int(np.searchsorted(held[0], held[0, -1], "left")) if held.shape[1] else 0  # the last key may go on; a task sends two rows of a key at most
            if last >= 1 << 15:
                yield settled(held[:, :last])
                held = held[:, last:]
        yield settled(held)

    ordered = rows.repartition("key").sortWithinPartitions("key", "w", "doc", "uid", "place")
    return map_batches(ordered, run, "kind bigint, uid bigint, a bigint, z bigint")


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """docs (stored) as doc (null: LAST), doc_id, text, file, at; and a number for each file, a list as Spark's own scan has."""
    files = [r[0] for r in docs.select("_metadata.file_path").distinct().collect()]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), empty_if_null("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return rows, {f: i for i, f in enumerate(sorted(files))}


def _uids(b: pa.RecordBatch, number: dict[str, int]) -> np.ndarray:
    coded = b.column("file").dictionary_encode()
    of = np.array([number[f] for f in coded.dictionary.to_pylist()], np.int64)
    return (of[np.asarray(coded.indices)] << ROW_BITS) + np.asarray(b.column("at"))


def _runs(uid: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a batch that are in one file and in order, so that pages can be read by range."""
    breaks = (np.nonzero((np.diff(uid) < 0) | (uid[1:] >> ROW_BITS != uid[:-1] >> ROW_BITS))[0] + 1).tolist()
    return [(x, y) for x, y in zip([0, *breaks], [*breaks, len(uid)], strict=True) if x < y]


def covered(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> tuple[DataFrame, dict[str, int]]:
    """uid, a, z: stretches to remove of each stored row; and the files' numbers. They may touch or overlap."""
    rows, number = _numbered(docs)

    def seen(batches):
        held, n = [], 0
        for b in batches:
            data, limits = utf8(b.column("text"))
            start, strings, offset, key = windows(data, limits, length)
            text = np.searchsorted(limits, start, "right") - 1
            raw = data.tobytes()
            w = b"".join([hashlib.blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(start.tolist(), (start + strings - 1 + length).tolist(), strict=True)])
            doc = np.asarray(b.column("doc_id").fill_null(LAST))
            held.append((key.view(np.int64), np.frombuffer(w, np.int64), doc[text], _uids(b, number)[text], place_of(start - limits[text], strings, offset)))
            n += len(start)
            if n >= CHUNK:
                yield _firsts(*map(np.concatenate, zip(*held, strict=True)), True, length)
                held, n = [], 0
        if n:
            yield _firsts(*map(np.concatenate, zip(*held, strict=True)), True, length)

    found = written(_compared(map_batches(rows, seen, SENT_TYPE), True, length), "windows")
    open_ = found.where(F.col("kind") == WINDOW).select("uid", F.col("a").alias("place"), F.col("z").alias("key"))
    pages = rows.sparkSession.sparkContext.broadcast(write_pages(open_, ["uid", "place", "key"], ["uid", "place"]))

    def fetched(batches):
        there = Pages(pages.value, 3, 16)
        for b in batches:
            data, limits = utf8(b.column("text"))
            uid, doc, raw = _uids(b, number), np.asarray(b.column("doc_id").fill_null(LAST)), data.tobytes()
            for x, y in _runs(uid):
                u, place, key = there.between(int(uid[x]), int(uid[y - 1]))
                row = x + np.searchsorted(uid[x:y], u)
                held = uid[np.minimum(row, y - 1)] == u  # a part of a file may be read
                u, place, key, row = u[held], place[held], key[held], row[held]
                start, strings, _ = unplaced(place)
                begin = limits[row] + start
                some = [raw[i:j] for i, j in zip(begin.tolist(), (begin + strings - 1 + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[row]), pa.array(u), pa.array(place), pa.array(some, pa.binary())], ["key", "doc", "uid", "place", "some"])

    edges = written(map_batches(rows, fetched, "key bigint, doc bigint, uid bigint, place bigint, some binary"), "edges")
    crowded = cut(edges.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))

    def sorted_(batches):
        def settled(b: pa.Table) -> pa.RecordBatch:
            data, limits = utf8(b.column("some").combine_chunks())
            key, uid, place = (np.asarray(b.column(c)) for c in ("key", "uid", "place"))
            start, strings, offset = unplaced(place)
            window = np.repeat(np.arange(len(uid)), strings)
            step = np.arange(len(window)) - np.repeat(np.cumsum(strings) - strings, strings)
            _, code = np.unique(key, return_inverse=True)
            group = code[window] * (2 << 16) + offset[window] - step + (1 << 16)  # anchor, and how far from it the string starts
            order = np.argsort(group, kind="stable")
            _, back, size = np.unique(group[order], return_inverse=True, return_counts=True)
            order = order[size[back] > 1]
            again = order[repeats(data, (limits[window] + step)[order], group[order], length)]
            at = start[window[again]] + step[again]
            u, a, z = merged(uid[window[again]], at, at + length)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (u, a, z)], ["uid", "a", "z"])

        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            held = b if held is None else pa.concat_tables([held, b])
            key = np.asarray(held.column("key"))
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # `crowd` windows of the last key at most
            if last * (length - part(length) + 1) >= BLOCK:
                yield settled(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield settled(held)

    few = edges if crowded.isEmpty() else edges.join(crowded, "key", "left_anti").select(edges.columns)
    ordered = few.repartition("key").sortWithinPartitions("key", "doc", "uid", "place")
    stretch = "uid bigint, a bigint, z bigint"
    covers = found.where(F.col("kind") == COVER).select("uid", "a", "z").unionByName(map_batches(ordered, sorted_, stretch))
    if not crowded.isEmpty():
        covers = covers.unionByName(_by_string(edges.join(crowded, "key", "left_semi"), length))
    return covers, number


def _by_string(edges: DataFrame, length: int) -> DataFrame:
    """uid, a, z of windows whose anchor too many have: each string is known by a digest of 128 bits."""

    def seen(batches):
        held, n = [], 0
        for b in batches:
            uid, doc, place = (np.asarray(b.column(c)) for c in ("uid", "doc", "place"))
            start, strings, _ = unplaced(place)
            raw = b.column("some").to_pylist()
            window = np.repeat(np.arange(len(uid)), strings)
            step = np.arange(len(window)) - np.repeat(np.cumsum(strings) - strings, strings)
            digest = b"".join([hashlib.blake2b(raw[i][j : j + length], digest_size=16).digest() for i, j in zip(window.tolist(), step.tolist(), strict=True)])
            key, w = np.frombuffer(digest, np.int64).reshape(-1, 2).T
            held.append((key, w, doc[window], uid[window], place_of(start[window] + step, np.ones_like(step), np.zeros_like(step))))
            n += len(window)
            if n >= CHUNK:
                yield _firsts(*map(np.concatenate, zip(*held, strict=True)), False, length)
                held, n = [], 0
        if n:
            yield _firsts(*map(np.concatenate, zip(*held, strict=True)), False, length)

    return _compared(map_batches(edges.select("key", "doc", "uid", "place", "some"), seen, SENT_TYPE), False, length).select("uid", "a", "z")


def without_repeats(docs: DataFrame, length: int = LENGTH, stored: bool = False, with_kept: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document and, if asked for, kept (the bytes that remain) and spans (start, end).

    stored: docs is a bare table as read from Parquet files, whose rows are known by file and place; any other is written
    first. Null texts are empty; texts shorter than `length` lose nothing; a null doc_id comes after all others, and
    rows of one doc_id as they stand. Repeated rows are documents of their own, so all but the first lose what is
    `length` bytes or more. Other columns are ignored; no rows give no rows. A text's bytes have to fit in a row (2 GB).
    """
    if not stored:
        docs = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), empty_if_null("text")), "rows")
    rows, _ = _numbered(docs)
    covers, number = covered(docs, length, crowd)
    pages = docs.sparkSession.sparkContext.broadcast(write_pages(covers, ["uid", "a", "z"], ["uid", "a", "z"]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        there = Pages(pages.value, 3, 16)
        for b in batches:
            data, limits = utf8(b.column("text"))
            uid, raw, at = _uids(b, number), data.tobytes(), limits.tolist()
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for x, y in _runs(uid):
                u, a, z = merged(*there.between(int(uid[x]), int(uid[y - 1])))
                cuts = [*np.searchsorted(u, uid[x:y]).tolist(), 0]
                ends = np.searchsorted(u, uid[x:y], "right").tolist()
                a, z = a.tolist(), z.tolist()
                for i in range(x, y):
                    mine = range(cuts[i - x], ends[i - x])
                    text, kept, done = raw[at[i] : at[i + 1]], [], 0
                    for j in mine:
                        kept.append(text[done : a[j]])
                        done = z[j]
                    kept = b"".join([*kept, text[done:]])
                    values = len(text), len(text) - len(kept), len(mine), hashlib.sha256(kept).hexdigest(), kept if with_kept else b"", [{"start": a[j], "end": z[j]} for j in mine] if with_kept else []
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), kind]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    got = map_batches(rows, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return got if with_kept else got.drop("kept", "spans")
