"""Sets of k-mers and products of windows of sequences that fit in a row, made where the sequences are.

Bases are dealt out by seq_id, a byte each, and no k-mer is shuffled. Rows with one seq_id are one sequence's, as they
are to a join or a group. Short sequences are worked on together, by sorted numbers that hold the sequence, the place and
the k-mer; one of over LONG bases by itself, a share of its k-mers or a few of its bands at a time, so that memory
doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ani, classify
from ..functions.kmers import CHUNK, canonical, kmers, murmur3, reverse_only
from ..plans.params import Params
from ..sources import kmerdb

#: Bases of short sequences that are worked on together; what is longer than the second is gone through in shares of that size.
BLOCK, LONG = 1 << 18, 1 << 22
#: Sequences of a block at most.
GROUPS = 1 << 12
#: Rows of a database that tasks look k-mers up in; a larger one is joined.
KNOWN = 1 << 21
LOW = (1 << 32) - 1

Rows = list[bytes]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. (np.unique hashes numbers first, which takes over ten times as long.)"""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and how often each is there."""
    x = np.sort(x)
    at = np.nonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))[0]
    return x[at], np.diff(np.append(at, len(x)))


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers are among `known`, sorted ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def blocks(batches, size: int = BLOCK, groups: int = GROUPS) -> Iterator[tuple[pa.Array, list[Rows]]]:
    """The seq_ids and rows of sequences, whole ones, of `size` bases together; one that is longer is alone. Rows come by seq_id."""
    ids, held, total = [], [], 0
    now, rows, n, kind = None, None, 0, None
    for b in batches:
        kind = b.column("seq_id").type
        for i, seq in zip(b.column("seq_id").to_pylist(), b.column("seq").to_pylist(), strict=True):
            if rows is None or i != now:
                if rows is not None:
                    if held and (total + n > size or len(held) >= groups):
                        yield pa.array(ids, kind), held
                        ids, held, total = [], [], 0
                    ids.append(now)
                    held.append(rows)
                    total += n
                now, rows, n = i, [], 0
            if seq is not None:
                rows.append(seq)
                n += len(seq)
    if rows is not None:
        if held and total + n > size:
            yield pa.array(ids, kind), held
            ids, held = [], []
        yield pa.array([*ids, now], kind), [*held, rows]


def by_sequence(seqs: DataFrame, run: Callable[[Iterator], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """seq_id and what `run` makes of the blocks of seqs(seq_id, seq)."""
    kind = seqs.schema["seq_id"].dataType.simpleString()
    rows = seqs.select("seq_id", F.col("seq").cast("binary").alias("seq")).repartition("seq_id").sortWithinPartitions("seq_id")
    return rows.mapInArrow(lambda batches: run(batches), f"seq_id {kind}, {out}")


def table(ids: pa.Array, group: np.ndarray, **columns) -> Iterator[pa.RecordBatch]:
    """A batch of rows of the groups given by number; none without rows."""
    if len(group):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(group.astype(np.int64))), *(pa.array(c) for c in columns.values())], ["seq_id", *columns])


def size_of(sequences: list[Rows]) -> int:
    return sum(len(s) for rows in sequences for s in rows)


def placed(sequences: list[Rows], k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All sequences' bases together, and of each k-mer in them where it is there, its sequence's number and its position."""
    rows = [(g, s) for g, rows in enumerate(sequences) for s in rows if len(s) >= k]
    n = np.array([len(s) for _, s in rows], np.int64)
    first, m = np.cumsum(n) - n, n - k + 1
    pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return b"".join(s for _, s in rows), np.repeat(first, m) + pos, np.repeat(np.array([g for g, _ in rows], np.int64), m), pos


def hashed(sequences: list[Rows], k: int, sketched: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, position and canonical value of all k-mers; sketched: of those that sketch() keeps."""
    joined, at, group, pos = placed(sequences, k)
    values = canonical(joined, k)[at]
    if sketched:
        keep = np.nonzero((values & 3 == 0) & (values != 0))[0]
        return group[keep], pos[keep], values[keep]
    return group, pos, values


def unsigned(values: np.ndarray) -> np.ndarray:
    """32-bit values as numbers from 0 on, in their order."""
    return values.astype(np.int64) + (1 << 31)


def pieces(rows: Rows, k: int, size: int = CHUNK) -> Iterator[tuple[int, Rows]]:
    """A long sequence's rows, the same `size` positions of each at a time, with where they begin."""
    for first in range(0, max(map(len, rows), default=0), size):
        yield first, [s[first : first + size + k - 1] for s in rows]


# --- distinct k-mers -------------------------------------------------------------------------------------------


def _strings(rows: Rows, k: int, both: bool) -> np.ndarray:
    """k-mers as fixed strings; both: the lesser of each and its reverse complement."""
    found = []
    for s in rows:
        if len(s) >= k:
            cut = lambda b: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint8), k)).view(f"S{k}").ravel()
            word = cut(s)
            if both:
                other = cut(_turned(s))[::-1]
                word = np.where(other < word, other, word)
            found.append(word)
    return np.concatenate(found) if found else np.zeros(0, f"S{k}")


_TURN = bytes.maketrans(b"ACTG", b"TGAC")


def _turned(s: bytes) -> bytes:
    return s[::-1].translate(_TURN)


def _long_words(rows: Rows, k: int, both: bool, share: int) -> tuple[int, int, bytes, bytes]:
    """Count, distinct count, least and greatest of one sequence's k-mers, the k-mers of one share of hashes after another."""
    shares = max(1, -(-sum(map(len, rows)) // share))
    n, sizes, least, most = 0, 0, None, None
    for x in range(shares):
        held, waiting, total = np.zeros(0, f"S{k}"), [], 0
        for _, piece in pieces(rows, k, min(CHUNK, share)):
            words = _strings(piece, k, both)
            if shares > 1:
                h = np.concatenate([murmur3(np.frombuffer(s, np.uint8), k) for s in piece])
                if both:
                    h ^= np.concatenate([reverse_only(s, k).view(np.uint32) for s in piece])
                words = words[h % np.uint32(shares) == x]
            n += len(words)
            waiting.append(distinct(words))
            total += len(waiting[-1])
            if total > share:
                held, waiting, total = distinct(np.concatenate([held, *waiting])), [], 0
        held = distinct(np.concatenate([held, *waiting]))
        if len(held):
            sizes += len(held)
            least = held[0] if least is None else min(least, held[0])
            most = held[-1] if most is None else max(most, held[-1])
    pad = lambda w: bytes(w).ljust(k, b"\0")  # noqa: E731  numpy drops zeros at a string's end
    return (n, sizes, pad(least), pad(most)) if n else (0, 0, b"", b"")


def word_counts(seqs: DataFrame, k: int, both: bool = False, share: int = LONG) -> DataFrame:
    """seq_id, n, n_distinct, least, greatest of each sequence's k-mers as upper-case strings; both: of the lesser of each and its reverse complement."""

    def run(batches):
        for ids, sequences in blocks(batches, min(BLOCK, share)):
            joined, at, group, pos = placed(sequences, k)
            b = np.frombuffer(joined, np.uint8)
            known = np.zeros(256, bool)
            known[b] = True
            known[list(b"ACTG")] |= both
            width = max(1, int(known.sum() - 1).bit_length())
            if size_of(sequences) > share or width * k + len(sequences).bit_length() > 63:
                got = [_long_words(rows, k, both, share) for rows in sequences]
                keep = np.nonzero([x[0] for x in got])[0]
                n, sizes, least, most = zip(*(got[g] for g in keep), strict=True) if len(keep) else ((),) * 4
                yield from table(ids, keep, n=np.array(n, np.int64), n_distinct=np.array(sizes, np.int64), least=pa.array(least, pa.binary()), greatest=pa.array(most, pa.binary()))
                continue
            if not len(at):
                continue
            rank = np.cumsum(known) - 1
            code = _codes(rank[b], k, width)[at]
            if both:
                other = _codes(rank[np.frombuffer(_turned(joined), np.uint8)], k, width)[::-1][at]
                code = np.minimum(code, other)
            each = distinct(group << (k * width) | code)
            of = each >> (k * width)
            first = np.nonzero(np.diff(of, prepend=-1))[0]
            last = np.append(first[1:], len(each)) - 1
            letters = np.nonzero(known)[0].astype(np.uint8)
            spell = lambda x: pa.array(_spelled(x, letters, k, width), pa.binary())
            here = of[first]
            yield from table(ids, here, n=np.bincount(group, minlength=len(sequences))[here], n_distinct=last - first + 1, least=spell(each[first]), greatest=spell(each[last]))

    rows = seqs.select("seq_id", F.upper(F.col("seq").cast("string")).alias("seq"))
    got = by_sequence(rows, run, "n bigint, n_distinct bigint, least binary, greatest binary")
    return got.select("seq_id", "n", "n_distinct", F.col("least").cast("string").alias("least"), F.col("greatest").cast("string").alias("greatest"))


def _codes(ranks: np.ndarray, k: int, width: int) -> np.ndarray:
    """All k-letter windows as numbers in the order of their strings."""
    n = max(0, len(ranks) - k + 1)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code = code << width | ranks[i : i + n]
    return code


def _spelled(codes: np.ndarray, letters: np.ndarray, k: int, width: int) -> list[bytes]:
    shift = (k - 1 - np.arange(k)) * width
    return [row.tobytes() for row in letters[codes[:, None] >> shift & ((1 << width) - 1)]]


def hash_counts(seqs: DataFrame, k: int, share: int = LONG) -> DataFrame:
    """seq_id, n, n_ambiguous, n_distinct of each sequence's canonical k-mers; 0, the ambiguous ones, isn't among the distinct."""

    def long(rows: Rows) -> tuple[int, int, int]:
        shares, n, zeros, sizes = -(-sum(map(len, rows)) // share), 0, 0, 0
        for x in range(shares):
            held = np.zeros(0, np.int32)
            for _, piece in pieces(rows, k, min(CHUNK, share)):
                values = hashed([piece], k)[2]
                n, zeros = n + len(values) * (x == 0), zeros + int((values == 0).sum()) * (x == 0)
                held = distinct(np.concatenate([held, values[(values != 0) & (values.view(np.uint32) % np.uint32(shares) == x)]]))
            sizes += len(held)
        return n, zeros, sizes

    def run(batches):
        for ids, sequences in blocks(batches, min(BLOCK, share)):
            if size_of(sequences) > share:
                n, zeros, sizes = (np.array([x]) for x in long(sequences[0]))
            else:
                group, _, values = hashed(sequences, k)
                total = lambda g: np.bincount(g, minlength=len(sequences))
                keep = values != 0
                n, zeros, sizes = total(group), total(group[~keep]), total(distinct(group[keep] << 32 | unsigned(values[keep])) >> 32)
            here = np.nonzero(n)[0]
            yield from table(ids, here, n=n[here], n_ambiguous=zeros[here], n_distinct=sizes[here])

    return by_sequence(seqs, run, "n bigint, n_ambiguous bigint, n_distinct bigint")


# --- chunks and the core ---------------------------------------------------------------------------------------


def _middle(pos: np.ndarray, n) -> np.ndarray:
    return (pos >= n // 3) & (pos < 2 * n // 3)


def _chunk_pairs(group, pos, values, core, inside, length) -> np.ndarray:
    """Distinct (sequence, chunk, k-mer) of those in the core, as the numbers of their sequence and chunk; `inside` are there anyway."""
    held = inside.copy()
    rest = np.nonzero(~inside & (values != 0))[0]
    held[rest] = member(group[rest] << 32 | unsigned(values[rest]), core)
    chunk = pos[held] // length
    place = np.cumsum(np.concatenate([np.zeros(min(1, len(chunk)), np.int64), (np.diff(chunk) != 0) | (np.diff(group[held]) != 0)]))
    if not len(place):
        return np.zeros((2, 0), np.int64)
    first = np.nonzero(np.diff(place, prepend=-1))[0]
    number = group[held][first] << 40 | chunk[first]  # of a place; rows with one seq_id may have the same
    known, same = np.unique(number, return_inverse=True)
    each = distinct(same[place] << 32 | unsigned(values[held]))
    n = np.bincount(each >> 32, minlength=len(known))
    return np.stack([known, n])


def core_chunks(seqs: DataFrame, k: int, length: int, share: int = LONG) -> DataFrame:
    """seq_id, chunk, shared: of each chunk of `length` positions, the distinct k-mers that the sequence's middle third holds too. Sequences without a name have none."""

    def long(rows: Rows) -> np.ndarray:
        size = max(1, min(CHUNK, share) // length) * length
        n = max(map(len, rows)) - k + 1
        shares = -(-sum(map(len, rows)) // share)
        total = np.zeros(-(-max(n, 1) // length), np.int64)
        for x in range(shares):
            mine = lambda v: (v != 0) & (v.view(np.uint32) % np.uint32(shares) == x)
            core = np.zeros(0, np.int64)
            for first, piece in pieces(rows, k, size):
                if first < 2 * n // 3 and first + size > n // 3:
                    _, pos, values = hashed([piece], k)
                    core = distinct(np.concatenate([core, unsigned(values[_middle(pos + first, n) & mine(values)])]))
            for first, piece in pieces(rows, k, size):
                _, pos, values = hashed([piece], k)
                keep = mine(values)
                pos, values = pos[keep] + first, values[keep]
                number, found = _chunk_pairs(np.zeros(len(pos), np.int64), pos, values, core, _middle(pos, n), length)
                total[number] += found
        return total

    def run(batches):
        for ids, sequences in blocks(batches, min(BLOCK, share)):
            if size_of(sequences) > share:
                if ids[0].is_valid:
                    total = long(sequences[0])
                    at = np.nonzero(total)[0]
                    yield from table(ids, np.zeros(len(at), np.int64), chunk=at, shared=total[at])
                continue
            group, pos, values = hashed(sequences, k)
            inside = _inside(ids, sequences, group, pos, values)
            number, found = _chunk_pairs(group, pos, values, distinct(group[inside] << 32 | unsigned(values[inside])), inside, length)
            yield from table(ids, number >> 40, chunk=number & ((1 << 40) - 1), shared=found)

    return by_sequence(seqs, run, "chunk bigint, shared bigint")


def _inside(ids, sequences, group, pos, values) -> np.ndarray:
    """Which k-mers are in the middle third of their sequence, with a name, and not ambiguous."""
    n = np.zeros(len(sequences), np.int64)
    np.maximum.at(n, group, pos + 1)
    return _middle(pos, n[group]) & (values != 0) & np.asarray(ids.is_valid())[group]


def last_in_core(seqs: DataFrame, k: int, within: int, share: int = LONG) -> DataFrame:
    """seq_id, last_match: the last position below `within` whose k-mer the middle third holds; 0 without one, and where there are fewer positions."""

    def long(rows: Rows) -> int:
        n = max(map(len, rows)) - k + 1
        group, pos, values = hashed([[s[: within + k - 1] for s in rows]], k)
        held = np.zeros(len(pos), bool)
        for first, piece in pieces(rows, k, min(CHUNK, share)):
            if first < 2 * n // 3 and first + CHUNK > n // 3:
                _, at, core = hashed([piece], k)
                held |= member(values, distinct(core[_middle(at + first, n) & (core != 0)]))
        return int(pos[held].max(initial=0))

    def run(batches):
        for ids, sequences in blocks(batches, min(BLOCK, share)):
            n = np.array([sum(max(0, len(s) - k + 1) for s in rows) for rows in sequences])
            if size_of(sequences) > share:
                last = np.array([long(sequences[0]) if ids[0].is_valid else 0])
            else:
                group, pos, values = hashed(sequences, k)
                inside = _inside(ids, sequences, group, pos, values)
                near = np.nonzero((pos < within) & (values != 0))[0]
                key = lambda at: group[at] << 32 | unsigned(values[at])
                near = near[member(key(near), distinct(key(inside)))]
                last = np.zeros(len(sequences), np.int64)
                np.maximum.at(last, group[near], pos[near])
            here = np.nonzero(n)[0]
            yield from table(ids, here, last_match=np.where(n < within, 0, last)[here])

    return by_sequence(seqs, run, "last_match bigint")


# --- classes ---------------------------------------------------------------------------------------------------


def ranked(seqs: DataFrame, db: DataFrame, k: int, most: int | None = None, share: int = LONG, known: int = KNOWN) -> DataFrame:
    """query_id, class, overlap, pct, rank of each sequence's distinct k-mers and db(class, kmer): the rows of classify.overlaps, or with `most` of classify.top.

    A database of up to `known` rows is sent to the tasks, which look their sequences' k-mers up; else k-mers are joined.
    """
    held = db.select("class", "kmer").distinct().limit(known + 1).toArrow()
    if held.num_rows > known:
        queries = kmers(seqs, k, distinct=True).where("kmer <> 0").select(F.col("seq_id").alias("query_id"), "kmer")
        return classify.top(queries, kmerdb.bucketed(db), most) if most else classify.overlaps(queries, kmerdb.bucketed(db))
    own = held.column("class").to_pylist()
    names = sorted(set(own), key=lambda x: (x is not None, x or ""))
    number = {name: i for i, name in enumerate(names)}
    values = unsigned(held.column("kmer").to_numpy())
    order = np.argsort(values, kind="stable")
    sent = seqs.sparkSession.sparkContext.broadcast((values[order], np.array([number[x] for x in own], np.int64)[order]))
    kind, first = db.schema["class"].dataType.simpleString(), min(len(names), 2 * (most or 0))

    def met(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the values that have some: the value's place, and the class."""
        keys, classes = sent.value
        low = np.searchsorted(keys, values)
        n = np.searchsorted(keys, values, "right") - low
        at = np.repeat(np.arange(len(values)), n)
        return at, classes[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def long(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shares, n, total = -(-sum(map(len, rows)) // share), 0, np.zeros(len(names), np.int64)
        for x in range(shares):
            mine = np.zeros(0, np.int32)
            for _, piece in pieces(rows, k, min(CHUNK, share)):
                values = hashed([piece], k)[2]
                mine = distinct(np.concatenate([mine, values[(values != 0) & (values.view(np.uint32) % np.uint32(shares) == x)]]))
            n += len(mine)
            total += np.bincount(met(unsigned(mine))[1], minlength=len(names))
        return np.array([n]), np.nonzero(total)[0], total[total > 0]

    def run(batches):
        for ids, sequences in blocks(batches, min(BLOCK, share)):
            if size_of(sequences) > share:
                n, code, overlap = long(sequences[0])
            else:
                group, _, values = hashed(sequences, k)
                keep = values != 0
                each = distinct(group[keep] << 32 | unsigned(values[keep]))
                n = np.bincount(each >> 32, minlength=len(sequences))
                at, of = met(each & LOW)
                code, overlap = counted((each[at] >> 32) * len(names) + of)
            named = np.asarray(ids.is_valid())[code // max(1, len(names))]  # a query without a name shares nothing
            code, overlap = code[named], overlap[named]
            asked = np.nonzero(n)[0]
            if most:
                spare = (asked[:, None] * len(names) + np.arange(first)).ravel()
                spare = spare[~member(spare, code)]
                group, of = np.divmod(np.concatenate([code, spare]), max(1, len(names)))
            else:
                spare = asked[~member(asked, distinct(code // max(1, len(names))))]  # one row, of no class
                group, of = np.concatenate([code // max(1, len(names)), spare]), np.concatenate([code % max(1, len(names)), np.full(len(spare), -1)])
            overlap = np.concatenate([overlap, np.zeros(len(spare), np.int64)])
            order = np.lexsort((of, -overlap, group))
            group, of, overlap = group[order], of[order], overlap[order]
            begin = np.nonzero(np.diff(group, prepend=-1))[0]
            rank = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group)))) + 1
            keep = rank <= (most or len(names) + 1)
            group, of, overlap, rank = group[keep], of[keep], overlap[keep], rank[keep]
            yield from table(ids, group, of=of, overlap=overlap, pct=overlap * 100.0 / n[group], rank=rank.astype(np.int32))

    got = by_sequence(seqs, run, "of bigint, overlap bigint, pct double, rank int")
    listed = F.broadcast(seqs.sparkSession.createDataFrame(list(enumerate(names)), f"of bigint, class {kind}"))
    return got.join(listed, "of", "left").select(F.col("seq_id").alias("query_id"), "class", "overlap", "pct", "rank")


# --- windows ---------------------------------------------------------------------------------------------------

#: Pairs of windows that share a k-mer from which a band is multiplied instead, and pairs that are counted together.
PAIRS = 1 << 20


class Windows:
    """The sketched k-mers of the windows of some bands, each a unit by number.

    plain, wide: sorted distinct numbers of unit, k-mer and window; group, band, ready: each unit's sequence, its band, and whether it is asked for.
    """

    def __init__(self, group: np.ndarray, pos: np.ndarray, values: np.ndarray, p: Params, groups: int, first: int = 0, last: int | None = None, wanted: int = 0):
        """Of bands first to last - 1, those from `wanted` on are asked for; pos counts from the sequence's begin."""
        self.bits = max(1, (p.windows - 1).bit_length())
        band, local = pos // p.band, pos % p.band
        carried = np.nonzero((band > first) & (local < p.interval))[0]
        own = np.nonzero(band < last)[0] if last is not None else np.arange(len(band))
        group, values = np.concatenate([group[own], group[carried]]), unsigned(np.concatenate([values[own], values[carried]]))
        local = np.concatenate([local[own], local[carried] + p.band])
        band = np.concatenate([band[own], band[carried] - 1])
        count = np.zeros(groups, np.int64)
        np.maximum.at(count, group, band - first + 1)
        base = np.cumsum(count) - count
        unit = base[group] + band - first
        self.group = np.repeat(np.arange(groups), count)
        self.band = np.arange(len(self.group)) - np.repeat(base, count) + first
        self.ready = self.band >= wanted
        key = (unit << 32 | values) << self.bits
        self.plain = distinct((key | local // p.window)[: len(own)])
        low = np.maximum(0, (local - p.interval) // p.window)
        n = np.minimum(p.windows - 1, (local + p.interval) // p.window) - low + 1
        self.wide = distinct(np.repeat(key, n) | np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()))

    def sides(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of numbers of unit, k-mer and window: those of unit and window, and the k-mers."""
        return pairs >> (32 + self.bits) << self.bits | pairs & ((1 << self.bits) - 1), pairs >> self.bits & LOW

    def sizes(self) -> np.ndarray:
        """How many k-mers each unit's plain windows hold."""
        return np.bincount(self.sides(self.plain)[0], minlength=len(self.group) << self.bits)

    def shared(self, step: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """unit, i, j, c: the k-mers that plain window i of a unit shares with wide window j of the unit `step` further on, which is the same sequence's.

        Windows that share a k-mer are counted pair by pair; a band with over PAIRS such pairs is multiplied.
        """
        bits, low = self.bits, (1 << self.bits) - 1
        a, b = self.plain, self.wide
        if step:
            there = np.arange(len(self.group)) + step
            same = (there >= 0) & (there < len(self.group))
            same[same] = self.group[there[same]] == self.group[same]
            a = a[same[a >> (32 + bits)]]
        sought, kept = (a >> bits) + (step << 32), b >> bits
        first = np.searchsorted(kept, sought)
        n = np.searchsorted(kept, sought, "right") - first
        unit = a >> (32 + bits)
        total = np.bincount(unit, weights=n, minlength=len(self.group)).astype(np.int64)
        for u in np.nonzero(total > PAIRS)[0]:
            x = a[slice(*np.searchsorted(unit, (u, u + 1)))]
            y = b[slice(*np.searchsorted(kept >> 32, (u + step, u + step + 1)))]
            mine, other = ((s & low, s >> bits & LOW) for s in (x, y))
            c = ani._product(mine, other, int(mine[0].max()) + 1, int(other[0].max()) + 1, 4096)
            i, j = np.nonzero(c)
            yield np.full(len(i), u), i, j, c[i, j].astype(np.int64)
        few = np.nonzero((total > 0) & (total <= PAIRS))[0]
        for us in np.split(few, np.nonzero(np.diff((np.cumsum(total[few]) - 1) // PAIRS))[0] + 1):
            if len(us):
                x = slice(*np.searchsorted(unit, (us[0], us[-1] + 1)))
                keep = np.nonzero((total[unit[x]] <= PAIRS) & (n[x] > 0))[0] + x.start
                m = n[keep]
                j = b[np.repeat(first[keep] - (np.cumsum(m) - m), m) + np.arange(m.sum())] & low
                left = a[keep]
                code, c = counted(np.repeat((left >> (32 + bits) << bits | left & low) << bits, m) | j)
                yield code >> (2 * bits), code >> bits & low, code & low, c


def windowed(batches, p: Params, share: int, back: bool = False) -> Iterator[tuple[pa.Array, Windows]]:
    """The windows of all bands of the sequences; back: those of the band before each are there as well. Of a long sequence some bands at a time."""
    for ids, sequences in blocks(batches, min(1 << 20, share), min(GROUPS, max(1, (1 << 22) // p.windows))):
        if size_of(sequences) <= share:
            yield ids, Windows(*hashed(sequences, p.k, True), p, len(sequences))
            continue
        step = max(1, min(1 << 20, share) // p.band)
        for band in range(0, -(-max(map(len, sequences[0])) // p.band), step):
            first = max(0, band - back)
            part = [s[first * p.band : (band + step) * p.band + p.interval + p.k - 1] for s in sequences[0]]
            group, pos, values = hashed([part], p.k, True)
            yield ids, Windows(group, pos + first * p.band, values, p, 1, first, band + step, band)


def _bands(ids: pa.Array, w: Windows, unit: np.ndarray, **columns) -> Iterator[pa.RecordBatch]:
    keep = w.ready[unit]
    yield from table(ids, w.group[unit[keep]], band=w.band[unit[keep]], **{name: c[keep] for name, c in columns.items()})


def window_sums(seqs: DataFrame, p: Params, wide: bool, share: int = LONG) -> DataFrame:
    """seq_id, band, win, n, total: count and sum of the distinct sketched k-mers of plain windows, or of those that reach further."""

    def run(batches):
        for ids, w in windowed(batches, p, share):
            place, value = w.sides(w.wide if wide else w.plain)
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order] - (1 << 31)
            first = np.nonzero(np.diff(place, prepend=-1))[0]
            if len(first):
                at = place[first]
                yield from _bands(ids, w, at >> w.bits, win=(at & ((1 << w.bits) - 1)).astype(np.int32), n=np.diff(np.append(first, len(place))), total=np.add.reduceat(value, first))

    return by_sequence(seqs, run, "band bigint, win int, n bigint, total bigint")


def intersections(seqs: DataFrame, p: Params, share: int = LONG) -> DataFrame:
    """seq_id, band, i, j, c: the sketched k-mers that plain window i shares with wide window j, as ani.intersections counts them."""

    def run(batches):
        for ids, w in windowed(batches, p, share):
            for unit, i, j, c in w.shared():
                yield from _bands(ids, w, unit, i=i.astype(np.int32), j=j.astype(np.int32), c=c)

    return by_sequence(seqs, run, "band bigint, i int, j int, c bigint")


def _best(w: Windows, unit, i, j, share) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greatest share of each unit, i and j."""
    key = (unit << w.bits | i) << w.bits | j
    order = np.argsort(key)
    key, share = key[order], share[order]
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    key, low = key[first], (1 << w.bits) - 1
    return key >> (2 * w.bits), key >> w.bits & low, key & low, np.maximum.reduceat(share, first) if len(first) else share


def cells(seqs: DataFrame, p: Params, least: float = 0.0, share: int = LONG) -> DataFrame:
    """seq_id, band, i, j, score: the cells of ani.cells, those of `least` and more."""

    def run(batches):
        for ids, w in windowed(batches, p, share):
            size = w.sizes()
            for unit, i, j, c in w.shared():  # all of a unit come together
                there = np.nonzero((i != j) & (size[unit << w.bits | j] > 0))[0]
                unit, i, j, c = unit[there], i[there], j[there], c[there]
                unit, i, j, best = _best(w, unit, np.minimum(i, j), np.maximum(i, j), c / size[unit << w.bits | i])
                score = best ** (1 / p.k) * 100
                keep = score >= least
                yield from _bands(ids, w, unit[keep], i=i[keep].astype(np.int32), j=j[keep].astype(np.int32), score=score[keep])

    return by_sequence(seqs, run, "band bigint, i int, j int, score double")


def cross_band(seqs: DataFrame, p: Params, share: int = LONG) -> DataFrame:
    """seq_id, band, i, j, score: window i of a band against windows j >= i of the band before it, as ani.cross_band scores them."""

    def run(batches):
        for ids, w in windowed(batches, p, share, True):
            size = w.sizes()
            found = []
            for unit, i, j, c in w.shared(-1):
                found.append((unit, i, j, c / size[unit << w.bits | i]))
            for unit, x, y, c in w.shared(1):  # the earlier band's plain window x, the later one's wide window y
                found.append((unit + 1, y, x, c / size[unit << w.bits | x]))
            if found:
                unit, i, j, part = map(np.concatenate, zip(*found, strict=True))
                there = np.nonzero((j >= i) & (size[unit << w.bits | i] > 0) & (size[unit - 1 << w.bits | j] > 0))[0]
                unit, i, j, best = _best(w, unit[there], i[there], j[there], part[there])
                yield from _bands(ids, w, unit, i=i.astype(np.int32), j=j.astype(np.int32), score=best ** (1 / p.k) * 100)

    return by_sequence(seqs, run, "band bigint, i int, j int, score double")
