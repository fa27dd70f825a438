"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (byte-class bigrams and how well it compresses, through a
tanh layer), gated attention gives each a weight (softmax over the document of w . tanh(V h) * sigmoid(U h)), and the
weighted mean of the encodings is scored by a logistic unit. Only documents have labels; the attention learns which
passages speak for them. Training and scoring read whole texts, every passage of them, and see nothing but the text.

The training bags stay on the executors: each step of Adam is a Spark job that sums the gradients of all bags, so the
driver holds weights and sums alone, however long the labelled texts are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, map_batches, utf8, written

PASSAGE = 4096  # bytes
#: Training takes at most so many labelled documents of each class, whole.
PER_CLASS = 1500
HIDDEN, GATE, STEPS, RATE, DECAY, SEED = 24, 12, 120, 0.04, 1e-4, 7
FOLDS, THRESHOLD = 5, 0.3

CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!?", ":;", "'\"`", "()[]{}", "|", "#$%&*@^~=+<>\\/_-"]
LEAD, TAIL, OTHER = 13, 14, 15  # of characters beyond ASCII; anything else, and a passage's end


def _class_of() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for i, chars in enumerate(CLASSES):
        out[list(chars.encode())] = i
    out[0x80:0xC0], out[0xC0:] = TAIL, LEAD
    return out


CLASS_OF = _class_of()
FEATURES = 256 + 3


def passages(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' passages: each one's start and end in the data, and rows' limits in passages. An empty text has one, empty."""
    count = np.maximum(1, -(-np.diff(at) // PASSAGE))
    limits = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    start = at[row] + (np.arange(limits[-1]) - limits[row]) * PASSAGE
    return start, np.minimum(start + PASSAGE, at[row + 1]), limits


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row for each passage: square roots of its shares of byte-class bigrams, compressed size per byte, and length."""
    out = np.zeros((len(start), FEATURES), np.float32)
    size = end - start
    i = 0
    while i < len(start):  # about a MB at a time
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 20), "right")))
        at, part = np.cumsum(size[i:j]), CLASS_OF[data[start[i] : end[j - 1]]]
        if len(part):
            code = part.astype(np.int64) << 4
            code[:-1] |= part[1:]
            full = size[i:j] > 0
            code[(at - 1)[full]] |= OTHER  # the last byte's partner is in the next passage
            code += np.repeat(np.arange(j - i) << 8, size[i:j])
            counts = np.bincount(code, minlength=(j - i) << 8).reshape(-1, 256)
            out[i:j, :256] = np.sqrt(counts / np.maximum(1, size[i:j, None]))
        i = j
    raw = memoryview(np.ascontiguousarray(data))
    packed = np.fromiter((len(zlib.compress(raw[a:z], 1)) for a, z in zip(start.tolist(), end.tolist(), strict=True)), np.float64, len(start))
    out[:, 256] = packed / (size + 12)
    out[:, 257] = np.log1p(size) / 8
    out[:, 258] = size == 0
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by name; mean and scale standardise features. With prior, every score is that."""

    w: dict[str, np.ndarray] | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.5

    def score(self, x: np.ndarray, limits: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(limits) - 1, self.prior)
        return forward(self.w, (x - self.mean) / self.scale, limits)["p"]


def forward(w: dict[str, np.ndarray], x: np.ndarray, limits: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    a = (t * g) @ w["w"]
    first, row = limits[:-1], np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    e = np.exp(a - np.maximum.reduceat(a, first)[row])
    att = e / np.add.reduceat(e, first)[row]
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "g": g, "att": att, "z": z, "row": row, "p": sigmoid(z @ w["c"] + w["d"])}


def gradients(w, x, limits, y, weight):
    f = forward(w, x, limits)
    dz_ = (f["p"] - y) * weight
    row, h, att, t, g = f["row"], f["h"], f["att"], f["t"], f["g"]
    dz = dz_[:, None] * w["c"]
    dh = att[:, None] * dz[row]
    datt = (dz[row] * h).sum(1)
    da = att * (datt - np.add.reduceat(att * datt, limits[:-1])[row])
    dt, dg = da[:, None] * w["w"] * g * (1 - t * t), da[:, None] * w["w"] * t * g * (1 - g)
    dh += dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": f["z"].T @ dz_, "d": dz_.sum()[None]}


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    normal = lambda rows, *shape: rng.normal(0, rows**-0.5, (rows, *shape))
    return {"W": normal(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "w": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(1)}


def summed(bags: DataFrame, f) -> dict[str, np.ndarray]:
    """f(x, limits, y), a dict of arrays, of each batch of bags, summed over the executors; {} without bags."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                raw, at = utf8(b.column("x"))
                x = np.frombuffer(raw.tobytes(), np.float32).reshape(-1, FEATURES)
                for k, v in f(x, at // (4 * FEATURES), np.asarray(b.column("quality")).astype(np.float32)).items():
                    total[k] = total[k] + v if k in total else np.asarray(v, np.float64)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([list(total[k].shape) for k in keys], pa.list_(pa.int32())), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["k", "shape", "v"])

    out: dict[str, np.ndarray] = {}
    for r in map_batches(bags, run, "k string, shape array<int>, v binary").collect():  # a few thousand weights a task
        v = np.frombuffer(r.v, np.float64).reshape(r.shape)
        out[r.k] = out[r.k] + v if r.k in out else v
    return out


def moments(x, limits, y):
    wide = x.astype(np.float64)
    return {"n": [len(x)], "sum": wide.sum(0), "squares": (wide * wide).sum(0), "labels": [(y == 0).sum(), (y == 1).sum()]}


def train(bags: DataFrame) -> Model:
    """Adam on all bags (quality, x: a row of float32 features a passage) at every step; classes weigh alike. One class alone, or none, gives a constant."""
    m = summed(bags, moments)
    if not m or not m["labels"].all():
        return Model(None, prior=float(m["labels"][1] > 0) if m else 0.5)
    mean = m["sum"] / m["n"]
    scale = np.sqrt(np.maximum(0, m["squares"] / m["n"] - mean * mean)) + 0.01
    mean, scale, share = mean.astype(np.float32), scale.astype(np.float32), (0.5 / m["labels"]).astype(np.float32)
    w = start()
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        now = {k: a.astype(np.float32) for k, a in w.items()}
        for k, grad in summed(bags, lambda x, limits, y, now=now: gradients(now, (x - mean) / scale, limits, y, share[y.astype(np.int64)])).items():
            grad = grad + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model({k: a.astype(np.float32) for k, a in w.items()}, mean, scale)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from at most per_class labelled rows of each class outside the held-out fold (chosen by a hash of doc_id).

    Labels other than 0 and 1, and null ids, are ignored; a doc_id labelled twice has its larger label. Of documents
    with the same doc_id the one of the least text hash is the training row, read whole; a null text is an empty one.
    Without labels, with one class alone, or without documents, the model is constant.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("quality = 0").orderBy(*order).limit(per_class).unionByName(known.where("quality = 1").orderBy(*order).limit(per_class))
    texts = ids_and_text(docs).join(F.broadcast(chosen), "doc_id")  # 2 x per_class rows of two numbers
    rows = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.sha2(F.col("text").cast("binary"), 256)).alias("text"))

    def bags(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            begin, end, limits = passages(at)
            x = features(data, begin, end)
            cuts = pa.array(limits * (4 * FEATURES), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, cuts.buffers()[1], pa.py_buffer(x)]).cast(pa.binary())], ["doc_id", "quality", "x"])

    return train(written(map_batches(rows, bags, "doc_id bigint, quality int, x binary"), "bags"))


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    data, at = utf8(texts)
    start, end, limits = passages(at)
    return model.score(features(data, start, end), limits).astype(np.float64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row for each row of docs. Null and empty texts are scored too, as an empty passage."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(model, b.column("text")))], ["doc_id", "score"])

    return map_batches(ids_and_text(docs), run, "doc_id bigint, score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns.

    Null and empty texts are scored as an empty passage; repeated rows and ids are judged each; no rows give no rows.
    """

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column("text")) >= threshold))

    return map_batches(docs, run, docs.schema)
