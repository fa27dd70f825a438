"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template words: numbers and units are typed placeholders, a capitalised word is a name's
placeholder or itself, all else is lower-case without outer punctuation. So two words match if they are equal but for
case, or both capitalised, whatever else the benchmark or the document holds. Windows of WINDOW template words of the
benchmark, in all their readings, are a hash table; documents' windows are joined to it. An item whose windows a
document holds to a share of `least`, along one stretch of the document, is a candidate, and its slots are then checked:
each placeholder value of the item must stand for one value of the document throughout, and each of the document's for
one of the item. So a question with other numbers or names is found, and a text that merely has the same shape isn't.
Of a long item a part is enough: RUN template words or more without a gap, whatever their share, with the same check.

The benchmark is the stated query set. It is taken in blocks of bounded bytes; each block's table is broadcast and the
documents are scanned against it once, with no shuffle of documents and no pairs but those reported.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import empty_if_null, ids_and_text, map_batches, with_row, without_rows

WINDOW, LEAST, SLOTS, RUN, BLOCK_BYTES = 5, 0.8, 0.9, 50, 8 << 20
KNOWN, LONGEST, STEP = 1 << 18, 64, 1 << 16

# Words that are numbers, and words and signs that are units after a number.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset("mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh kph hz khz mhz ghz v volt volts w watt watts kw j joule joules n newton newtons pa c f k".split())

NUM, NAME, UNIT = 1, 2, 3  # placeholders' codes; words' codes follow
_digits = re.compile(r"[$€£#+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?", re.ASCII)
_number_unit = re.compile(r"([$€£+-]?\d[\d.,]*)(%|[a-zA-Zµ°]{1,4})", re.ASCII)
_outer = re.compile(r"^[\W_]+|[\W_]+$")
_ends = (".", "!", "?", ":", ";")


def kinds(token: str) -> list[tuple[str, str]]:
    """A token's template words (mark, value): "#" a number, "u" a unit, "n" a capitalised word, "" any other in lower case."""
    core = _outer.sub("", token)
    if not core:
        return []
    if _digits.fullmatch(core):
        return [("#", core)]
    if m := _number_unit.fullmatch(core):
        if m[2].lower() in UNITS or m[2] == "%":
            return [("#", m[1]), ("u", m[2].lower())]
    low = core.lower()
    if low in NUMBERS:
        return [("#", low)]
    return [("u" if low in UNITS else "n" if core[0].isupper() and core[1:].islower() else "", low)]


class Memo(dict):
    """Tokens' packed entries, made when first met; forgotten when there are too many. Long tokens aren't kept, so that bytes have a bound too."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str) -> int:
        if len(token) > LONGEST:
            return self.make(token)
        if len(self) > KNOWN:
            self.clear()
        self[token] = entry = self.make(token)
        return entry


WORD, NAME_ONLY, EITHER = 0, 1, 2  # how a template word is read: as itself, as a name's placeholder, as both


class Words:
    """Codes of template words: those of the benchmark block have their own; any other word is 0.

    A capitalised word is read as a name's placeholder too. `names` are words that the block has as names alone: in a
    text that has them capitalised the placeholder suffices to match them.
    """

    def __init__(self, vocabulary: dict[str, int], names: frozenset[str] = frozenset(), grow: bool = False):
        self.vocabulary, self.names, self.grow, self.seen = vocabulary, names, grow, Memo(self.entry)

    def entry(self, token: str) -> int:
        """Packed: code + 1 (0: not one word), how it is read, and whether it is a unit if after a number."""
        parts = kinds(token)
        if len(parts) != 1:
            return 0
        mark, low = parts[0]
        if mark == "#":
            code = NUM
        elif self.grow:
            code = self.vocabulary.setdefault(low, len(self.vocabulary) + 4)
        else:
            code = self.vocabulary.get(low, 0)
        how = WORD if mark != "n" else NAME_ONLY if code == 0 or low in self.names else EITHER
        return (code + 1) << 3 | how << 1 | (mark == "u")

    def template(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Codes of the text's template words, how each is read, each one's token, and the tokens."""
        tokens = text.split()
        n = len(tokens)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), tokens
        packed = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, n)
        codes, how, where = (packed >> 3) - 1, packed >> 1 & 3, np.arange(n)
        codes[1:][(packed[1:] & 1 > 0) & (codes[:-1] == NUM)] = UNIT
        odd = np.nonzero(codes == -1)[0]
        if len(odd):
            parts, ways, places, last = [], [], [], 0
            for i in odd.tolist():
                inner = [NUM if mark == "#" else UNIT for mark, _ in kinds(tokens[i])]
                parts += [codes[last:i], np.array(inner, np.int64)]
                ways += [how[last:i], np.zeros(len(inner), np.int64)]
                places += [where[last:i], np.full(len(inner), i)]
                last = i + 1
            codes, how, where = (np.concatenate([*x, y[last:]]) for x, y in ((parts, codes), (ways, how), (places, where)))
        return codes, how, where, tokens


def names_in(texts: list[str]) -> frozenset[str]:
    """Words that are capitalised in mid-sentence and nowhere in lower case."""
    capital, lower = set(), set()
    for text in texts:
        for line in text.split("\n"):
            begins = True
            for token in line.split():
                for mark, low in kinds(token):
                    if mark == "":
                        lower.add(low)
                    elif mark == "n" and not begins:
                        capital.add(low)
                begins = token.rstrip("\"')]}").endswith(_ends)
    return frozenset(capital - lower)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c.astype(np.uint64)) * MIX
    return h ^ h >> np.uint64(29)


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` codes."""
    n = max(0, len(codes) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mixed(h, codes[i : i + n])
    return h


def readings(codes: np.ndarray, how: np.ndarray, size: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every reading of the windows that begin at first to last - 1; those with a word that the block lacks have none."""
    main = np.where(how == WORD, codes, NAME)
    last = max(first, len(codes) - size + 1) if last is None else last
    gone = np.concatenate([[0], np.cumsum(main[first : last + size - 1] == 0)])
    at = first + np.nonzero(gone[size:] == gone[: len(gone) - size])[0] if last > first else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        c = main[at + i]
        both = np.nonzero(how[at + i] == EITHER)[0]
        if len(both):
            c = np.concatenate([c, codes[at[both] + i]])
            at, h = np.concatenate([at, at[both]]), np.concatenate([h, h[both]])
        h = mixed(h, c)
    return at, h


@dataclass
class Item:
    """An item's template: `named` are its own names' places (capitalised in mid-sentence, nowhere in lower case)."""

    item_id: int | None
    codes: np.ndarray
    how: np.ndarray
    named: np.ndarray
    values: list[str]
    hashes: np.ndarray
    size: int

    def readings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Its distinct windows' hashes and first places, and the hash of each reading, in order, with the window that it is of."""
        distinct, place, own = np.unique(self.hashes, return_index=True, return_inverse=True)
        at, h = readings(self.codes, self.how, self.size)
        of = own[at]
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        return distinct, place, h[new], of[new]


class Block:
    """The window table of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], window: int, least: float):
        self.vocabulary: dict[str, int] = {}
        words = Words(self.vocabulary, grow=True)
        self.items: list[Item] = []
        self.window, self.least = window, least
        short: dict[int, list[int]] = defaultdict(list)
        plain: set[int] = set()  # codes that some item has as words alone
        for item_id, text in items:
            codes, how, where, tokens = words.template(text)
            if not len(codes):
                continue  # nothing to look for
            named = np.isin(codes, [self.vocabulary[w] for w in names_in([text]) if w in self.vocabulary])
            how = np.where(named, EITHER, how)
            plain.update(codes[how == WORD].tolist())
            size = min(window, len(codes))
            self.items.append(Item(item_id, codes, how, named, values(codes, how, where, tokens), windows(np.where(named, NAME, codes), size), size))
            short[size].append(len(self.items) - 1)
        self.names = frozenset(w for w, c in self.vocabulary.items() if c not in plain)
        self.tables = {size: self._table(members) for size, members in short.items()}

    def _table(self, members: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, their limits, and items: of each item the readings of its rarest windows, one of which must be in a text that holds its share, and of windows that lie so close that a run has one."""
        distinct = {k: np.unique(self.items[k].hashes) for k in members}
        all_hashes, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
        h, k = [], []
        for m, own in distinct.items():
            rarest = np.lexsort((own, counts[np.searchsorted(all_hashes, own)]))[: len(own) - int(np.ceil(self.least * len(own))) + 1]
            item = self.items[m]
            _, _, read, of = item.readings()
            posts = np.searchsorted(own, item.hashes[:: self._run(item)]) if len(item.codes) >= RUN else rarest
            keep = np.unique(read[np.isin(of, np.union1d(rarest, posts))])
            h.append(keep)
            k.append(np.full(len(keep), m))
        h, k = np.concatenate(h), np.concatenate(k)
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        keys, first = np.unique(h, return_index=True)
        return keys, np.append(first, len(h)), k

    def _run(self, item: Item) -> int:
        """How many windows a run of RUN words has."""
        return max(1, RUN - item.size + 1)

    def matches(self, codes: np.ndarray, how: np.ndarray, where: np.ndarray, tokens: list[str]) -> list[tuple[int | None, float, int, int]]:
        """(item_id, share, first token, last token + 1) of each item that the text holds."""
        out = []
        for size, (keys, limits, members) in self.tables.items():
            last, hit = len(codes) - size + 1, np.zeros(0, np.int64)
            for i in range(0, last, STEP):
                _, hashes = readings(codes, how, size, i, min(i + STEP, last))
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                hit = np.union1d(hit, at[keys[at] == hashes])
            if not len(hit):
                continue
            for k in np.unique(np.concatenate([members[limits[i] : limits[i + 1]] for i in hit.tolist()])).tolist():
                if (found := self._verified(self.items[k], codes, how, where, tokens)) is not None:
                    out.append((self.items[k].item_id, *found))
        return out

    def _verified(self, item: Item, codes, how, where, tokens):
        distinct, place, keys, of = item.readings()
        last, p, which = len(codes) - item.size + 1, [], []
        for i in range(0, last, STEP):
            at, hashes = readings(codes, how, item.size, i, min(i + STEP, last))
            low = np.searchsorted(keys, hashes)
            n = np.searchsorted(keys, hashes, "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            held = of[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs = np.unique(np.repeat(at, n) * len(distinct) + held)  # a window of the text may have several readings
            p.append(pairs // len(distinct))
            which.append(pairs % len(distinct))
        p, which = np.concatenate(p), np.concatenate(which)
        steps = np.arange(item.size)
        equal = (item.codes[place[which][:, None] + steps] == codes[p[:, None] + steps]).sum(1)
        order = np.lexsort((-equal, p))  # of the item's windows that one of the text matches, the most alike tells the slots
        p, which = p[order], which[order]
        n, need = len(distinct), int(np.ceil(self.least * len(distinct)))
        if len(np.unique(which)) < need:
            return self._part(item, distinct, p, which, codes, how, where, tokens)
        span, best = int(1.5 * len(item.codes)) + 1, None
        a, held, kinds_held = 0, defaultdict(int), 0
        for z in range(len(p)):  # the stretch of at most `span` words that holds most of the item's windows
            held[which[z]] += 1
            kinds_held += held[which[z]] == 1
            while p[z] - p[a] >= span:
                held[which[a]] -= 1
                kinds_held -= held[which[a]] == 0
                a += 1
            if kinds_held >= need and (best is None or kinds_held > best[0]):
                if self._consistent(item, p[a : z + 1], place[which[a : z + 1]], codes, how, where, tokens):
                    best = (kinds_held, a, z)
                    if kinds_held == n:
                        break
        if best is None:
            return self._part(item, distinct, p, which, codes, how, where, tokens)
        share, a, z = best
        return share / n, int(where[p[a]]), int(where[min(p[z] + item.size, len(where)) - 1]) + 1

    def _part(self, item: Item, distinct: np.ndarray, p: np.ndarray, which: np.ndarray, codes, how, where, tokens):
        """The longest consistent run of at least RUN of the item's words, the first of several: (share of its windows, first token, last token + 1)."""
        least = self._run(item)
        if len(item.codes) < RUN or len(p) < least:
            return None
        own = np.searchsorted(distinct, item.hashes)
        held = np.unique(p * len(distinct) + which)
        shifts: set[int] = set()
        for q in range(0, len(own), least):  # a run has one of these windows
            shifts.update((p[which == own[q]] - q).tolist())
        q, best = np.arange(len(own)), None
        for shift in sorted(shifts):
            at = (q + shift) * len(distinct) + own
            there = held[np.minimum(np.searchsorted(held, at), len(held) - 1)] == at
            edges = np.flatnonzero(np.diff(np.concatenate([[False], there, [False]]).astype(np.int8)))
            for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if z - a >= max(least, best[0] + 1 if best else 0) and self._consistent(item, q[a:z] + shift, q[a:z], codes, how, where, tokens):
                    best = z - a, a + shift, z - 1 + shift, len(np.unique(own[a:z]))
        if best is None:
            return None
        _, first, last, windows_held = best
        return windows_held / len(distinct), int(where[first]), int(where[min(last + item.size, len(where)) - 1]) + 1

    def _consistent(self, item: Item, at: np.ndarray, own: np.ndarray, codes, how, where, tokens) -> bool:
        """Whether slot values map one to one: a share SLOTS of the slots must hold a value together with its usual partner, seen from either side; a text all of slots must be equal."""
        steps = np.arange(item.size)
        theirs = (at[:, None] + steps).ravel()
        ours = (own[:, None] + steps).ravel()
        theirs, first = np.unique(theirs, return_index=True)
        ours = ours[first]
        slot = (item.codes[ours] <= UNIT) | item.named[ours] | (item.codes[ours] != codes[theirs])
        if not slot.any():
            return True
        found = values(codes[theirs[slot]], np.full(slot.sum(), EITHER), where[theirs[slot]], tokens)
        kind = np.minimum(item.codes[ours[slot]], UNIT + 1).tolist()
        pairs = Counter(zip(kind, (item.values[o] for o in ours[slot].tolist()), found, strict=True))
        total = int(slot.sum())
        if total * 2 > len(slot):  # little but slots: only the values tell
            return all(o == v for _, o, v in pairs)
        return min(usual(pairs, 1), usual(pairs, 2)) >= SLOTS * total


def usual(pairs: Counter, side: int) -> int:
    """Uses of (kind, ours, theirs) in which the value of one side meets its commonest partner."""
    best: dict[tuple[int, str], int] = defaultdict(int)
    for key, n in pairs.items():
        best[key[0], key[side]] = max(best[key[0], key[side]], n)
    return sum(best.values())


def values(codes: np.ndarray, how: np.ndarray, where: np.ndarray, tokens: list[str]) -> list[str]:
    """Each template word's value: the number, name or unit that a placeholder can stand for, or ""."""
    out = []
    for c, r, w in zip(codes.tolist(), how.tolist(), where.tolist(), strict=True):
        if r == WORD and (c == 0 or c > UNIT):
            out.append("")
            continue
        out.append(next((v for mark, v in kinds(tokens[w]) if (mark == "#") == (c == NUM)), "").lower())
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """The benchmark's items, in blocks of at most `most` bytes of text (or one item); only one is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), empty_if_null("text")).orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


_held: dict[str, tuple[Block, Words]] = {}


def held(key: str, sent: Broadcast, window: int, least: float) -> tuple[Block, Words]:
    """The sent block's table and its reader of words. A Python worker keeps one block, for those of its tasks that need it."""
    if key not in _held:
        _held.clear()
        block = Block(sent.value, window, least)
        _held[key] = block, Words(block.vocabulary, block.names)
    return _held[key]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, share, first, last: benchmark items that documents hold; words first to last - 1 are the passage.

    share is that of the item's distinct windows; it is below `least` only where a part of RUN words or more is held. Items shorter than a window are one window; items without a word
    match nothing. Null texts are empty and hold nothing. Repeated doc_ids give rows each; null ids stay null. Copies of
    an item are reported one by one. Other columns are ignored. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, share double, first int, last int"
    out = None
    for items in blocks(benchmark, most):

        def scan(batches, key=uuid.uuid4().hex, sent=spark.sparkContext.broadcast(items)):
            block, words = held(key, sent, window, least)
            for b in batches:
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    rows += [(doc, *m) for m in block.matches(*words.template(text))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "share", "first", "last"])

        got = map_batches(ids_and_text(docs), scan, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST, most: int = BLOCK_BYTES, stored: bool = False) -> DataFrame:
    """The rows of docs that hold no benchmark item and no part of one as contamination() tells, with all their columns; no text is shuffled.

    Null and empty texts hold nothing and stay; repeated rows are judged each; an empty benchmark leaves all rows, and
    no rows give no rows. A benchmark of one block filters as it scans. With more, each block is a scan of its own that
    notes the rows to drop, so that a task never has more than one block's table; see with_row on `stored`.
    """

    def filtered(rows: DataFrame, items: list, hold: bool, columns: list[str]) -> DataFrame:
        """The columns of those rows that hold an item of the block, or of those that hold none."""

        def scan(batches, key=uuid.uuid4().hex, sent=docs.sparkSession.sparkContext.broadcast(items)):
            block, words = held(key, sent, window, least)
            for b in batches:
                yield b.filter(pa.array([bool(block.matches(*words.template(t or ""))) == hold for t in b.column("text").to_pylist()], pa.bool_())).select(columns)

        return map_batches(rows, scan, T.StructType([f for f in rows.schema.fields if f.name in columns]))

    each = blocks(benchmark, most)
    first, second = next(each, None), next(each, None)
    if first is None:
        return docs
    if second is None:
        return filtered(docs, first, False, docs.columns)
    rows, name = with_row(docs, stored)
    gone = [filtered(rows.select(name, "text"), items, True, [name]) for items in itertools.chain([first, second], each)]
    return without_rows(rows, name, functools.reduce(DataFrame.unionByName, gone).select(f"{name}.*"))
