"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks, runs of text between block-level tags, each with its open elements. A block's
features are its ancestors' tags, the kinds that their class, id and role names hint at, and its text's length, links
and endings. The field scores each block as article or not and each pair of neighbours; Viterbi finds the best labels
of the page, and the article's blocks are its text. It is trained on labelled pages by exact gradients (forward and
backward sums, all pages at once).
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null, map_batches
from .html_pages import NAMES, OPEN, SHUT, pages

# HTML's elements without content, elements inside a line, those whose content is raw text and no part of the page, formulas and drawings, and what closes what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math nobr noscript object q rp rt ruby s samp small span strike strong sub sup svg time tt u var video wbr".split())
RAW = frozenset("script style iframe title".split())
FOREIGN = frozenset("math svg".split())
PHRASING_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("ul ol dl table select article section div body main aside nav form td th".split())
STOPS = frozenset().union(*SIBLINGS.values())
BACK = frozenset(["foreignobject", "annotation-xml"])
# Elements that are features of what is inside them.
ELEMENTS = (VOID | INLINE | FOREIGN | PHRASING_ENDS | SCOPES | STOPS | frozenset("button caption colgroup head label legend optgroup option select summary template textarea tfoot thead".split())) - {"html", "body", "div", "span"}
_raw_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}

# Quotes hold a tag together only after an equals sign; a quote that nothing closes is a letter like others, and a tag that nothing ends goes to the page's end.
_markup = re.compile(r"""<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+(?:>|\Z))""", re.DOTALL)
_named = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_hides = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _stems() -> dict[str, set[str]]:
    """Which kinds a word in a name hints at: those whose names of the training designs have it."""
    out: dict[str, set[str]] = {}
    for kind, names in NAMES.items():
        for name in names:
            for w in name.split("-"):
                out.setdefault(w, set()).add(kind)
    for w in ("site", "page", "bar", "list", "box", "section", "right", "column", "top", "bottom", "body", "main", "read", "more", "user", "reader", "us", "up", "slot", "tag", "posts", "post", "links", "link", "text", "copy", "meta", "x"):
        out.pop(w, None)
    return out | {"post": {"content"}, "main": {"content"}, "text": {"content"}}


HINTS = _stems()


@lru_cache(1 << 16)
def hints(names: str) -> frozenset[str]:
    """Kinds that a class, id or role value hints at; joined words are tried by their beginnings too."""
    found: set[str] = set()
    for word in _name_words.findall(names):
        w = word.lower()
        for form in (w, w.rstrip("s"), w + "s"):
            found |= HINTS.get(form, set())
        if not found:
            for stem, kinds in HINTS.items():
                if len(stem) >= 5 and w.startswith(stem) or len(stem) >= 7 and stem in w:
                    found |= kinds
    return frozenset(found)


class Path:
    """The open elements around a block, by what counts of them: made from the path one element shorter, of a bounded size."""

    __slots__ = ("own", "inside", "found")

    def __init__(self, outer: Path | None = None, tag: str = "", kinds: frozenset[str] = frozenset()):
        self.own, self.inside, self.found = (outer.own, outer.inside, outer.found) if outer else ("", "none", frozenset())
        if not outer:
            return
        new = [f"tag:{tag}"] if tag in ELEMENTS else []
        if tag in ("html", "body") or {"content"} < kinds <= {"content", "header", "side"}:
            kinds = kinds & {"hidden"}  # names of whole pages, "content-sidebar" and "post-header" say nothing of the block
        elif len(kinds) > 1:
            kinds = kinds - {"content"}  # "post-comments" has comments
        new += [f"kind:{k}" for k in kinds]
        if not self.found.issuperset(new):
            self.found = self.found.union(new)
        if tag in APART or kinds - {"content"}:
            self.inside = "other"  # the innermost element that tells decides what the block is inside of
        elif tag in ("article", "main") or kinds:
            self.inside = "article"
        if tag not in INLINE:
            self.own = tag if tag in ELEMENTS | {"html", "body", "div"} else "other"

    def features(self) -> frozenset[str]:
        return self.found | {f"own:{self.own}", f"inside:{self.inside}"}


@dataclass
class Block:
    text: str
    path: Path
    linked: int  # characters inside links


class _Stack:
    """The open elements, with what is asked of them kept at hand: a step costs what it opens or closes, however deep."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths = [Path()]
        self.places: dict[str, list[int]] = {}  # of each tag
        self.solid: list[int] = []  # elements that aren't inside a line
        self.stops: list[int] = []  # those that list items and cells look for
        self.worlds: list[int] = []  # formulas, drawings, and what brings page content back inside them

    def push(self, tag: str, kinds: frozenset[str]) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.paths.append(Path(self.paths[-1], tag, kinds))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.solid.append(at)
        if tag in SCOPES or tag in STOPS:
            self.stops.append(at)
        if tag in FOREIGN or tag in BACK:
            self.worlds.append(at)

    def cut(self, at: int) -> None:
        """Closes all from place `at` on."""
        while len(self.tags) > at:
            self.places[self.tags.pop()].pop()
            self.paths.pop()
        for kept in (self.solid, self.stops, self.worlds):
            while kept and kept[-1] >= at:
                kept.pop()

    def last(self, tag: str) -> int:
        """The innermost element's place; -1 without one."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def foreign(self) -> int | None:
        """The place of the innermost open formula or drawing, unless page content is open inside it."""
        return self.worlds[-1] if self.worlds and self.tags[self.worlds[-1]] in FOREIGN else None


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, white space made single spaces; blocks without text aren't any.

    Character references are decoded in each run of text by itself, so none is put together across markup. The time grows
    with the page's length, whatever it nests or leaves open.
    """
    out: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    path = stack.paths[0]
    linked, at, n = 0, 0, len(page)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, path, min(linked, len(text))))
            pieces.clear()
        linked = 0

    while at < n:
        m = _markup.search(page, at)
        raw = page[at : m.start()] if m else page[at:]
        if raw:
            if not pieces and raw.strip():
                path = stack.paths[-1]
            if pieces or raw.strip():
                pieces.append(entities.unescape(raw))
                linked += len(raw) if stack.places.get("a") else 0
        if not m:
            break
        at = m.end()
        close, start = m[1], m[2]
        if start:
            tag = start.lower()
            if tag in RAW:
                if not m[3].rstrip(">").endswith("/") or tag in ("script", "style", "title"):
                    end = _raw_ends[tag].search(page, at)
                    at = end.end() if end else n
                continue
            i = stack.foreign()
            if i is not None and (tag in PHRASING_ENDS or tag in SIBLINGS):
                stack.cut(i)  # no part of a formula or drawing, which is over or was never closed
                i = None
            inside = i is not None
            if tag not in INLINE and not inside:
                flush()
            if inside:
                pass
            elif tag in PHRASING_ENDS:
                if stack.solid and stack.tags[stack.solid[-1]] == "p":
                    stack.cut(stack.solid[-1])  # an open paragraph ends here
            elif tag in SIBLINGS:
                for i in reversed(stack.stops.copy() if len(stack.stops) < 16 else stack.stops[-16:]):  # between two scopes stands one of each kind at most
                    if stack.tags[i] in SIBLINGS[tag]:
                        stack.cut(i)
                    elif stack.tags[i] in SCOPES:
                        break
            if tag in VOID or inside and m[3].rstrip(">").endswith("/"):
                continue
            kinds: frozenset[str] = frozenset({"hidden"} if tag == "template" else ())
            if "=" in m[3] or "hidden" in m[3]:
                for name, a, b, c in _named.findall(m[3].rstrip(">")):
                    low, value = name.lower(), a or b or c
                    if low == "hidden" or low == "aria-hidden" and value == "true" or low == "style" and _hides.search(value):
                        kinds |= {"hidden"}
                    elif low in ("class", "id", "role"):
                        kinds |= hints(value)
            stack.push(tag, kinds)
        elif close:
            tag = close.lower()
            i = stack.foreign()
            if tag not in INLINE and (i is None or stack.last(tag) < i):
                flush()
            if stack.last(tag) >= 0:
                stack.cut(stack.last(tag))
    flush()
    return out


APART = frozenset("nav header footer aside form dialog menu button select textarea label".split())
_rights = re.compile(r"©|\(c\)|copyright|all rights reserved", re.IGNORECASE)


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    out = ["len:" + ("1" if n < 20 else "2" if n < 80 else "3" if n < 300 else "4")]
    share = b.linked / max(1, n)
    out.append("link:" + ("0" if share < 0.05 else "1" if share < 0.5 else "2"))
    if b.text[-1] in ".!?:;\"”'":
        out.append("ends")
    if n < 300 and _rights.search(b.text[:80]):
        out.append("rights")
    return out


class Field:
    """A linear-chain field over two labels; 1 is the article."""

    def __init__(self, names: list[str], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.weights = {f: (float(a), float(b)) for f, (a, b) in zip(names, emit, strict=True)}
        self.move, self.start = move.tolist(), start.tolist()
        self.paths: dict = {}

    def _emission(self, b: Block) -> float:
        """How much more the block is article than not."""
        key = b.path.found, b.path.own, b.path.inside
        if (known := self.paths.get(key)) is None:
            if len(self.paths) > 1 << 15:
                self.paths.clear()
            known = self.paths[key] = sum(w[1] - w[0] for f in b.path.features() if (w := self.weights.get(f)))
        return known + sum(w[1] - w[0] for f in text_features(b) if (w := self.weights.get(f)))

    def labels(self, found: list[Block]) -> list[int]:
        """Viterbi: the labels of highest joint score."""
        if not found:
            return []
        (m00, m01), (m10, m11) = self.move
        a, b = self.start
        b += self._emission(found[0])
        back = []
        for block in found[1:]:
            e = self._emission(block)
            back.append((int(b + m10 > a + m00), int(b + m11 >= a + m01)))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + e
        out = [int(b >= a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        return " ".join(b.text for b, y in zip(found, self.labels(found), strict=True) if y)


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a marked page and their labels."""
    found = blocks(page)
    labels = [int(OPEN in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(OPEN, "").replace(SHUT, "")
    keep = [i for i, b in enumerate(found) if b.text]
    return [found[i] for i in keep], [labels[i] for i in keep]


def train(marked: list[str], steps: int = 150, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Maximum likelihood with a small penalty, by Adam; the sums over labellings are exact."""
    data = [x for x in map(labelled, marked) if x[0]]
    feats = [[sorted(b.path.features()) + text_features(b) for b in bs] for bs, _ in data]
    names = sorted({f for bs in feats for b in bs for f in b})
    place = {f: i for i, f in enumerate(names)}
    n, most = len(data), max(len(bs) for bs, _ in data)
    x = np.zeros((n, most, len(names)), np.float32)
    y, mask = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for i, (bs, (_, ys)) in enumerate(zip(feats, data, strict=True)):
        for j, b in enumerate(bs):
            x[i, j, [place[f] for f in b]] = 1
        y[i, : len(ys)], mask[i, : len(ys)] = ys, True
    hot = np.eye(2)[y] * mask[..., None]
    flat, dense = x.reshape(-1, len(names))[mask.ravel()].astype(np.float64), np.zeros((n, most, 2))
    w = {"emit": np.zeros((len(names), 2)), "move": np.zeros((2, 2)), "start": np.zeros(2)}
    pairs = mask[:, 1:, None, None] * hot[:, :-1, :, None] * hot[:, 1:, None, :]
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    total = mask.sum()

    def logsum(a, axis):
        top = a.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

    for step in range(1, steps + 1):
        dense[mask] = flat @ w["emit"]
        e = dense
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = w["start"] + e[:, 0]
        for t in range(1, most):
            fwd[:, t] = np.where(mask[:, t, None], logsum(fwd[:, t - 1, :, None] + w["move"], 1) + e[:, t], fwd[:, t - 1])
        z = logsum(fwd[:, -1], 1)
        for t in range(most - 2, -1, -1):
            bwd[:, t] = np.where(mask[:, t + 1, None], logsum(w["move"] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), bwd[:, t + 1])
        p = np.exp(np.minimum(0, fwd + bwd - z[:, None, None])) * mask[..., None]
        pair = np.exp(np.minimum(0, fwd[:, :-1, :, None] + w["move"] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])) * mask[:, 1:, None, None]
        grads = {"emit": flat.T @ (p - hot)[mask], "move": (pair - pairs).sum((0, 1)), "start": (p[:, 0] - hot[:, 0]).sum(0)}
        for k, g in grads.items():
            g = g / total + decay * w[k] / 10
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Field(names, w["emit"], w["move"], w["start"])


TRAINING_PAGES = 500


@lru_cache(1)
def trained(n: int = TRAINING_PAGES) -> Field:
    return train(pages(n))


def extract(pages_: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages: the article's text.

    Null and empty html give an empty text; so do pages without an article. Repeated and null ids give rows each. Other columns are ignored.
    No rows give no rows.
    """
    model = model or trained()

    def run(batches):
        for b in batches:
            text = [model.text(h) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages_.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), empty_if_null("html")), run, "page_id bigint, url string, text string, n_chars bigint")
