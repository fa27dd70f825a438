"""Two tokenizers' tokens of the same text, aligned by a transducer over dangling suffixes.

Both sides spell the same bytes. Whichever has spelt more is ahead by a dangling suffix, the end of its last token. The
other side's next token meets that suffix: it shortens it, ends with it (a group closes), or runs past it and leaves
a suffix of its own. So a state is (side ahead, suffix), and a step depends on it and the next token alone; steps are
memoised. A step from a suffix links the two tokens that meet there, as their byte ranges overlap.

Both tokenizers break at single spaces, so what lies between two spaces closes its last group there, and its groups
and links are kept by word. A text with other white space or unusual characters goes through the transducer whole.

How many documents hold a pair of ids linked is counted over the corpus: a task counts the pairs of its documents first,
Spark sums the counts. They are written in pages sorted by pair, of which a task holds a bounded number at a time: no
table of all pairs is in one place.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_text, map_batches, utf8, written
from .pages import Pages, write_pages
from .tokens import ODD, PER_CALL, SPLIT, Encoder, Memo, byte_letters

#: Words, steps and pieces longer than this aren't kept, so that a memo's bytes have a bound.
KEPT_LETTERS, KEPT_WORDS, KEPT_STEPS = 64, 250_000, 200_000
#: Entries that a task counts before it sends its sums on.
BLOCK = 1 << 21


def apart(s: str) -> bool:
    """Whether either tokenizer may see more in a text than words between single spaces."""
    return bool(ODD.search(s)) or "  " in s or " \n" in s or "\n " in s or s[:1] in " \n" or s[-1:] == " "


class Plain(Encoder):
    """The byte-level side. Strings of added tokens are plain text, and long pieces aren't kept."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = re.compile(r"(?!)")
        back = {ord(c): b for b, c in byte_letters().items()}
        self.bytes = [bytes(t.translate(back).encode("latin-1")) if all(ord(c) in back for c in t) else t.encode() for t in map(self.tokenizer.id_to_token, range(self.vocab))]

    def word(self, s: str) -> bytes:
        return b"".join(self.pieces[p] if len(p) <= KEPT_LETTERS else self.pieces.make(p) for p in SPLIT.findall(s))


class Pieces:
    """The sentencepiece side, which puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocab = self.model.get_piece_size()
        piece = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = [piece(i) for i in range(self.vocab)]


class Transducer:
    """Groups and links of two id lists. left, right: the bytes of each id."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.sides = left, right
        self.steps = Memo(self._step, KEPT_STEPS)

    def _step(self, key: tuple[int, bytes, int]) -> tuple[int, bytes] | None:
        """The state after the side behind has taken a token: (side ahead, suffix); None where the bytes differ."""
        ahead, suffix, token = key
        new = self.sides[1 - ahead][token]
        if len(new) <= len(suffix):
            return (ahead, suffix[len(new) :]) if suffix.startswith(new) else None
        return (1 - ahead, new[len(suffix) :]) if new.startswith(suffix) else None

    def run(self, left: list[int], right: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """(groups, links) of ids; None where the two sides don't spell the same bytes."""
        ours, steps, groups, links = self.sides[0], self.steps, [], []
        i, j, n, m = 0, 0, len(left), len(right)
        while i < n:  # a group begins with the left side's token
            x, y, a = i, j, left[i]
            i, ahead, suffix = i + 1, 0, ours[a]
            while suffix:
                if ahead:
                    if i == n:
                        return None
                    a = left[i]
                    key, i = (1, suffix, a), i + 1
                else:
                    if j == m:
                        return None
                    b = right[j]
                    key, j = (0, suffix, b), j + 1
                links.append((a, b))
                state = steps[key] if len(suffix) <= KEPT_LETTERS else self._step(key)
                if state is None:
                    return None
                ahead, suffix = state
            groups.append((left[x:i], right[y:j]))
        return (groups, links) if j == m else None


class Words(dict):
    """Two generations of at most `limit` words each: what is used stays, what isn't goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def put(self, word: str, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value


class Aligner:
    """What a worker keeps: both tokenizers, the transducer, and the words it has met."""

    def __init__(self, left: str, right: str):
        self.a, self.b = Plain(left), Pieces(right)
        self.width = self.b.vocab
        self.machine = Transducer(self.a.bytes, self.b.bytes)
        self.kind = np.dtype("<u4") if self.a.vocab * self.width <= 1 << 32 else np.dtype("<u8")
        self.code = "I" if self.kind.itemsize == 4 else "Q"
        self.words = Words(KEPT_WORDS)

    def _aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple[int, int, int, bytes, bytes] | None:
        """Ids of either side, groups, the groups' text, and the links as numbers; None where a side spells other bytes."""
        if b"".join([self.a.bytes[i] for i in a]) != raw or (found := self.machine.run(a, b)) is None:
            return None
        groups, links = found
        text = ";".join([f"{x[0]}|{y[0]}" if len(x) == len(y) == 1 else f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
        return len(a), len(b), len(groups), text.encode(), array(self.code, [x * self.width + y for x, y in links]).tobytes()

    def of_words(self, words: list[str]) -> list[tuple | None]:
        """_aligned of words, each with a space before it; those that aren't known go to the right side in one call."""
        words_, found, new = self.words, [None] * len(words), []
        for i, w in enumerate(words):
            if w in words_:
                found[i] = words_[w]
            elif w in words_.old:
                found[i] = words_.old[w]
                words_.put(w, found[i])
            else:
                new.append(i)
        for i, b in zip(new, self.b.model.encode([words[i] for i in new], num_threads=1), strict=True):
            w = words[i]
            a = np.frombuffer(self.a.word(" " + w), self.a.dtype).tolist()
            found[i] = self._aligned(b" " + w.encode(), a, b)
            if len(w) <= KEPT_LETTERS:
                words_.put(w, found[i])
        return found

    def whole(self, texts: list[str]) -> list:
        out = []
        for i in range(0, len(texts), PER_CALL):
            some = texts[i : i + PER_CALL]
            for t, a, b in zip(some, self.a.tokenizer.encode_batch_fast([" " + t for t in some], add_special_tokens=False), self.b.model.encode(some, num_threads=1), strict=True):
                out.append(self._aligned(b" " + t.encode(), a.ids, b))
        return out

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, int, bytes, np.ndarray, np.ndarray] | None]:
        """For each text: ids of either side, groups, the groups' text, distinct links in order and how often each occurs; None where there are no tokens."""
        column = column.cast(pa.large_string()).fill_null("")
        texts = column.to_pylist()
        alone = np.fromiter((apart(s) if s else False for s in texts), bool, len(texts))
        plain = ~alone & np.fromiter(map(bool, texts), bool, len(texts))
        got: dict[int, tuple] = {}
        if plain.any():
            at = np.nonzero(plain)[0]
            of_words, strange = self._by_words(column.filter(pa.array(plain)))
            got = dict(zip(at.tolist(), of_words, strict=True))
            alone[at[strange]] = True
        at = np.nonzero(alone)[0].tolist()
        for i, found in zip(at, self.whole([texts[i] for i in at]), strict=True):
            got[i] = found and (*found[:4], *np.unique(np.frombuffer(found[4], self.kind), return_counts=True))
        return map(got.get, range(len(texts)))

    def _by_words(self, texts: pa.Array) -> tuple[list[tuple], np.ndarray]:
        """What rows() gives for texts that split at spaces, and which of them have a word that isn't spelt alike."""
        n = len(texts)
        parts = pc.split_pattern(texts, " ")
        limits = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        found = self.of_words(coded.dictionary.to_pylist())
        bad = np.fromiter((f is None for f in found), bool, len(found))
        found = [f or (0, 0, 0, b"", b"") for f in found]
        first = limits[:-1] - limits[0]
        sums = [np.add.reduceat(np.fromiter((f[k] for f in found), np.int64, len(found))[codes], first).tolist() for k in range(3)]
        spelt = np.array([f[3] for f in found], object)[codes].tolist()
        doc = np.repeat(np.arange(n), np.diff(limits))
        word, times = np.unique(doc * len(found) + codes, return_counts=True)  # a document's distinct words
        size = np.fromiter((len(f[4]) // self.kind.itemsize for f in found), np.int64, len(found))
        links, link = np.unique(np.frombuffer(b"".join(f[4] for f in found), self.kind), return_inverse=True)
        begin, code = np.cumsum(size) - size, word % len(found)
        each = size[code]
        place = np.repeat(begin[code] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        key = np.repeat(word // len(found), each) * max(1, len(links)) + link[place]
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, each)[order]
        new = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        often = np.add.reduceat(times, new) if len(new) else np.zeros(0, np.int64)
        owner, link = key[new] // max(1, len(links)), links[key[new] % max(1, len(links))]
        cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
        first = [*first.tolist(), len(codes)]
        out = [(a, b, g, b";".join(spelt[first[i] : first[i + 1]]), link[cuts[i] : cuts[i + 1]], often[cuts[i] : cuts[i + 1]]) for i, (a, b, g) in enumerate(zip(*sums, strict=True))]
        return out, np.logical_or.reduceat(bad[codes], first[:-1])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    """One a Python worker and pair of files."""
    if (left, right) not in _aligners:
        _aligners[left, right] = Aligner(left, right)
    return _aligners[left, right]


def aligned(docs: DataFrame, left: str, right: str, with_groups: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links, times and, if asked for, groups.

    links: its distinct linked pairs, ascending, as little-endian numbers a x (ids of the right side) + b of 4 or 8
    bytes; times: how often each occurs, 4 bytes each. groups: `a1,a2|b1;a3|b2,b3`, whose hash groups_sha256 is.
    """

    def run(batches):
        pair = aligner(left, right)
        for b in batches:
            out = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times", "groups")}
            for r in pair.rows(b.column("text")):
                a, z, g, text, links, times = r or (0, 0, 0, b"", np.zeros(0, pair.kind), np.zeros(0, np.int64))
                values = (a, z, g, int(times.sum()), hashlib.sha256(text).hexdigest() if r else "", links.tobytes(), times.astype("<u4").tobytes(), text.decode() if with_groups else "")
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    rows = map_batches(ids_and_text(docs), run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, times binary, groups string")
    return written(rows if with_groups else rows.drop("groups"), "aligned")


def link_counts(rows: DataFrame, kind: np.dtype, width: int) -> DataFrame:
    """pair, n (documents that hold it), best (whether no pair of its left id has more), from aligned's rows."""

    def counted(batches):
        def sums(held):
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

        held, size = [], 0
        for b in batches:
            held.append(np.frombuffer(utf8(b.column("links"))[0].tobytes(), kind))
            size += len(held[-1])
            if size >= BLOCK:
                yield sums(held)
                held, size = [], 0
        if size:
            yield sums(held)

    n = map_batches(rows.select("links"), counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    of_left = Window.partitionBy(F.expr(f"pair div {width}L"))  # at most `width` pairs
    return n.select("pair", "n", (F.col("n") == F.max("n").over(of_left)).cast("bigint").alias("best"))


def alignment(docs: DataFrame, left: str, right: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups: a row for each document.

    left: a byte-level BPE file of the tokenizers library, which gets a space before the text; right: a sentencepiece
    model, which adds one itself. Texts that are null or empty, or that either side doesn't spell byte for byte, have
    zeros and an empty hash. n_best counts links whose pair is held by most documents of all pairs with that left id;
    count_sum adds the pairs' counts. Repeated rows are documents of their own; other columns are ignored; no rows give
    no rows. Texts of any length are read whole.
    """
    rows = aligned(docs, left, right, with_groups)
    pair = aligner(left, right)
    kind, width = pair.kind, pair.width
    pages = docs.sparkSession.sparkContext.broadcast(write_pages(link_counts(rows, kind, width), ["pair", "n", "best"], ["pair"]))

    def run(batches):
        counts = Pages(pages.value, 3)
        for b in batches:
            raw, at = utf8(b.column("links"))
            links, at = np.frombuffer(raw.tobytes(), kind).astype(np.int64), at // kind.itemsize
            times = np.frombuffer(utf8(b.column("times"))[0].tobytes(), "<u4").astype(np.int64)
            distinct, back = np.unique(links, return_inverse=True)
            _, n, best = counts.of(distinct)
            running = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            added = {"n_best": running(times * best[back]), "count_sum": running(times * n[back])}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, added.values())], [*kept, *added])

    kept = [c for c in rows.columns if c not in ("links", "times")]
    out = map_batches(rows, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept) + ", n_best bigint, count_sum bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)
