"""Token ids of a byte-level BPE file, from the tokenizers library, at corpus speed.

Byte-level BPE never merges across the pieces that its split pattern makes, so the ids of a text are those of its
pieces in order. Most of a corpus's pieces repeat. Each batch is split at spaces and dictionary-encoded by Arrow;
only its distinct words are looked up, in a bounded memo, and only unknown pieces reach the library's model.
A text whose split at spaces may differ from the pattern's (runs of white space, unusual characters), and every text
of a tokenizer of another kind, is encoded whole by the library; so is a text that holds the string of an added token,
which the library reads as that token.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The byte-level split pattern over the characters that PLAIN allows.
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Texts with other characters than these aren't split at spaces, nor those of odd().
ODD = re.compile(rf"[^\n\x20-\x7e{LETTERS}×÷¡«»¿]")
MEMO = 200_000
#: Letters of the longest piece that a memo keeps.
LONGEST = 64
PER_CALL = 64


def odd(s: str) -> bool:
    """Whether a split at spaces may differ from the pattern's: other characters, three spaces, line ends beside spaces, spaces at an end."""
    return bool(ODD.search(s)) or "   " in s or " \n" in s or "\n " in s or s[:1] == " " or s[-1:] == " "


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo(dict):
    """Two generations of at most `limit` entries each: what is used stays, what isn't goes. Long keys aren't kept, so that bytes have a bound too."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t["content"]) for t in made.get("added_tokens") or []]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code, self.dtype = ("H", np.dtype("<u2")) if self.vocab <= 1 << 16 else ("I", np.dtype("<u4"))
        split = made.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer") and not made.get("post_processor") and made["model"]["type"] == "BPE"
        letters, tokenize, code = byte_letters(), self.tokenizer.model.tokenize, self.code
        space, line = letters[32], letters[10]

        def piece(s: str) -> bytes:
            mapped = s.replace(" ", space).replace("\n", line) if s.isascii() else s.encode().decode("latin-1").translate(letters)
            return array(code, [t.id for t in tokenize(mapped)]).tobytes()

        self.pieces = Memo(piece)

    def word(self, s: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, SPLIT.findall(s)))

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), PER_CALL):
            out += [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + PER_CALL], add_special_tokens=False)]
        return out

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, each row's ended by `end`, and the rows' limits. Null: empty."""
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        alone = np.fromiter((not self.by_piece or odd(s) or bool(self.added.search(s)) for s in column.to_pylist()), bool, n)
        plain = column.filter(pa.array(~alone)) if alone.any() else column
        flat, lens, limits = self._split(plain)
        if alone.any():
            texts = column.filter(pa.array(alone)).to_pylist()
            got = self.whole(texts)
            flat2 = np.frombuffer(b"".join(got), self.dtype)
            lens2 = np.fromiter((len(b) // self.dtype.itemsize for b in got), np.int64, len(got))
            starts = np.empty(n, np.int64)
            counts = np.empty(n, np.int64)
            starts[~alone], counts[~alone] = limits[:-1], lens
            starts[alone], counts[alone] = len(flat) + np.cumsum(lens2) - lens2, lens2
            flat = np.concatenate([flat, flat2])
        else:
            starts, counts = limits[:-1], lens
        extra = int(end is not None)
        out_limits = np.concatenate([[0], np.cumsum(counts + extra)])
        out = np.empty(out_limits[-1], self.dtype)
        if extra:
            out[out_limits[1:] - 1] = end
        put = np.repeat(out_limits[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        out[put] = flat if not alone.any() else flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        return out, out_limits

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ids a row, and rows' limits of texts that split at spaces."""
        n = len(texts)
        if not n:
            return np.empty(0, self.dtype), np.zeros(0, np.int64), np.zeros(1, np.int64)
        parts = pc.split_pattern(texts, " ")
        rows = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64)
        first = rows[:-1] - rows[0]
        # a row's first word has no space before it: such words get entries of their own, after the others
        heads, back = np.unique(codes[first], return_inverse=True)
        known, split = self.pieces.__getitem__, self.word
        ids = [known(" " + w) if w.isalpha() else split(" " + w) for w in words] + [split(words[h]) for h in heads.tolist()]
        codes = codes.copy()
        codes[first] = len(words) + back
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        bank = np.frombuffer(b"".join(ids), self.dtype)
        each = size[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        flat = bank[np.repeat(begin[codes] - (ends - each), each) + np.arange(total)]
        limits = np.concatenate([[0], ends])[rows - rows[0]]
        return flat, np.diff(limits), limits


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file, so that its memo serves all of the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
