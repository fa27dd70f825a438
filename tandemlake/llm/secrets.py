"""Secret scan over a trigram inverted index.

Each rule's regex is turned into a Boolean query of trigrams that every match must hold. A batch of texts is indexed:
each trigram that some query names gets its posting list (the rows that hold it, lower-cased), a query's postings are
intersected and united, and only candidate rows are searched with the regex. A rule whose regex needs no trigram scans
every row. A segment of the index is an Arrow batch, so it has a size bound, needs no shuffle and is built where the
text is read.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_text, map_batches, utf8

#: Strings that a node's exact set may have before it is turned into a query, and characters of a class that count as single ones.
MOST, FEW = 64, 8


@dataclass(frozen=True)
class Rule:
    """A pattern; the match counts if the group has at least `least` characters."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    #: The same spans as pattern and least, found faster.
    fast: str = ""

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.fast or self.pattern, self.flags | re.ASCII).finditer(text)
        return [m.span() for m in found if self.fast and None not in m.groups() or not self.fast and m.end(self.group) - m.start(self.group) >= self.least]


# The base rules' patterns and least lengths.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 0, 32, fast=r"[0-9a-f]{32,}"),
)
# Further public credential formats.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 0, 15),
    Rule("web_api", r"AIza[0-9A-Za-z_-]+", 0, 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", fast=r"eyJ[A-Za-z0-9_-]++(\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?"),  # no match begins inside a run that has failed
)
RULES = BASE + MORE

ALL = ("all",)


def both(a, b):
    return b if a == ALL else a if b == ALL else ("and", a, b)


def either(a, b):
    return ALL if ALL in (a, b) else ("or", a, b)


def of_strings(strings: set[str]):
    """The query that one of these strings is in the text."""
    needs = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    query = None
    for grams in sorted(map(sorted, (g for g in needs if not any(other < g for other in needs)))):  # the others follow from these
        one = ("grams", *grams) if grams else ALL
        query = one if query is None else either(query, one)
    return ALL if query is None else query


def trigrams_of(pattern: str, flags: int = 0):
    """The Boolean trigram query of a regex: ("grams", ...) all of them, ("and"|"or", a, b), or ALL if nothing is sure.

    A part of the regex is known by the exact set of lower-case strings it matches, while that is small, or else by a
    query alone. Strings are cut where a part without an exact set begins.
    """

    def seq(items) -> tuple[set[str] | None, tuple]:
        exact: set[str] | None = {""}
        query, whole = ALL, True
        for op, arg in items:
            strings, q = node(op, arg)
            if strings is not None and len(exact) * len(strings) <= MOST:
                exact = {a + b for a, b in product(exact, strings)}
            else:
                whole = False
                query = both(query, of_strings(exact))
                exact = strings if strings is not None and len(strings) <= MOST else {""}
                if strings is None:
                    query = both(query, q)
        return (exact, ALL) if whole else (None, both(query, of_strings(exact)))

    def node(op, arg) -> tuple[set[str] | None, tuple]:
        if op is sre.LITERAL:
            return {chr(arg).lower()}, ALL
        if op is sre.IN:
            members = [chr(x).lower() for o, x in arg if o is sre.LITERAL]
            return (set(members), ALL) if len(members) == len(arg) <= FEW else (None, ALL)
        if op is sre.SUBPATTERN:
            return seq(arg[3])
        if op is sre.BRANCH:
            parts = [seq(b) for b in arg[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
                return set().union(*(s for s, _ in parts)), ALL
            query = None
            for s, q in parts:
                one = q if s is None else of_strings(s)
                query = one if query is None else either(query, one)
            return None, query
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            strings, q = seq(body)
            if strings is not None and high == 1 and low == 0 and len(strings) < MOST:
                return strings | {""}, ALL
            if low == high == 1:
                return strings, q
            return None, (q if strings is None else of_strings(strings)) if low >= 1 else ALL
        if op is sre.AT:
            return {""}, ALL
        return None, ALL

    strings, query = seq(parser.parse(pattern, flags))
    return query if strings is None else of_strings(strings)


def grams_in(query) -> set[str]:
    return set(query[1:]) if query[0] == "grams" else set() if query == ALL else grams_in(query[1]) | grams_in(query[2])


class Segment:
    """The inverted index of one batch: a trigram's posting list holds the rows whose lower-cased text has it."""

    def __init__(self, data: np.ndarray, at: np.ndarray, wanted: set[str]):
        self.n = len(at) - 1
        codes = {g: int.from_bytes(g.encode("latin-1"), "big") for g in wanted if len(g.encode()) == 3}
        slot = np.zeros(1 << 24, np.uint8) if len(codes) < 255 else np.zeros(1 << 24, np.uint16)
        names = sorted(codes)
        for i, g in enumerate(names):
            slot[codes[g]] = i + 1
        fold = np.arange(256, dtype=np.uint32)
        fold[65:91] += 32
        hits_at, hits = [], []
        for x in range(0, max(0, len(data) - 2), 1 << 20):  # a window at a time, to stay in the processor's cache
            b = fold[data[x : x + (1 << 20) + 2]]
            s = slot[b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]]
            p = np.nonzero(s)[0]
            hits_at.append(p + x)
            hits.append(s[p])
        where = np.concatenate([np.zeros(0, np.int64), *hits_at])
        what = np.concatenate([np.zeros(0, slot.dtype), *hits])
        row = np.searchsorted(at, where, "right") - 1
        inside = where + 3 <= at[1:][row] if len(where) else np.zeros(0, bool)
        pairs = np.unique(what[inside].astype(np.int64) << 40 | row[inside])
        cuts = np.searchsorted(pairs >> 40, np.arange(1, len(names) + 2))
        self.postings = {g: (pairs[cuts[i] : cuts[i + 1]] & ((1 << 40) - 1)) for i, g in enumerate(names)}

    def rows(self, query) -> np.ndarray:
        """The rows that may match, in order."""
        if query == ALL:
            return np.arange(self.n)
        if query[0] == "grams":
            lists = sorted((self.postings.get(g, np.arange(self.n)) for g in query[1:]), key=len)
            out = lists[0]
            for other in lists[1:]:
                out = np.intersect1d(out, other, assume_unique=True)
            return out
        a, b = self.rows(query[1]), self.rows(query[2])
        return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)


def planned(rules: tuple[Rule, ...]) -> list[tuple[Rule, tuple]]:
    return [(r, trigrams_of(r.pattern, r.flags | re.ASCII)) for r in rules]


def find_in(texts: pa.Array, plan: list[tuple[Rule, tuple]]) -> list[list[tuple[int, int, int]]]:
    """For each row its spans (start, rule's place, end), in that order."""
    data, at = utf8(texts)
    index = Segment(data, at, set().union(*(grams_in(q) for _, q in plan)))
    raw, limits = data.tobytes(), at.tolist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(limits) - 1)]
    for k, (rule, query) in enumerate(plan):
        for i in index.rows(query).tolist():
            if found := rule.spans(raw[limits[i] : limits[i + 1]].decode()):
                out[i] += [(a, k, z) for a, z in found]
    for spans in out:
        spans.sort()
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), code points, end exclusive, by start and then the rules' order.

    A row for each row of docs, repeated and null doc_ids too; null and empty texts have no spans; other columns are
    ignored; no rows give no rows. Spans of one kind don't overlap; those of different kinds may.
    """
    kinds = [r.kind for r in rules]

    def scan(batches):
        plan = planned(rules)
        for b in batches:
            rows = [[{"kind": kinds[k], "start": a, "end": z} for a, k, z in spans] for spans in find_in(b.column("text"), plan)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    return map_batches(ids_and_text(docs), scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")
