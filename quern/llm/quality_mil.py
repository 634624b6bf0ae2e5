"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by counts of its own characters, words,
lines and repeats, never of the whole document's; gated attention weighs the encodings, and the
weighted mean is scored. A line belongs to the passage in which it starts. Weights come
from document labels alone, by gradient descent on a bounded sample of labelled rows: SAMPLE rows
of least hash among those that may be learned from. Every document is scored over its whole
text in passages of PASSAGE words, however long it is; the attention over more than BAG passages
is computed in running blocks of BAG.

Null, empty and blank texts are bags of one empty passage. Without a usable label every score is
0.5; with labels of one value alone, their smoothed share. A document labelled twice counts with
its larger label. A null id is held out and matches no label. Repeated rows are scored each, an
empty table gives an empty result, and columns that are not named are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import documents, labels
from .quality_rules import STOP_WORDS

PASSAGE = 64
BAG = 256
#: The classifier's bound: labelled rows it learns from.
SAMPLE = 4000
THRESHOLD = 0.3
HIDDEN, GATES, EPOCHS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4

KINDS = 9


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:", b"!?", b"#*$%&|<>", b"\"'()-_/\\[]{}@^~`+="), 1):
        kind[list(chars)] = k
    kind[128:] = KINDS - 1
    return kind


BYTE_KIND = _byte_kinds()
STOPS = frozenset(w.encode() for w in STOP_WORDS)
FEATURES = KINDS + 8


def encode(text: str | None, size: int = 0) -> np.ndarray:
    """The passages of a text as rows of FEATURES numbers: passages of `size` words, or where it
    is 0 of as many as give BAG rows at most."""
    raw = (text or "").encode()
    w = raw.split()
    n = len(w)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    size = size or max(PASSAGE, -(-n // BAG))
    of = np.arange(n) // size
    bag = int(of[-1]) + 1
    length = np.fromiter(map(len, w), np.int64, n)
    kinds = np.bincount(np.repeat(of, length) * KINDS + BYTE_KIND[np.frombuffer(b"".join(w), np.uint8)], minlength=bag * KINDS).reshape(bag, KINDS)
    count = np.bincount(of, minlength=bag)
    mean = np.bincount(of, length, bag) / count
    spread = np.sqrt(np.maximum(np.bincount(of, length * length, bag) / count - mean * mean, 0))
    stops = np.bincount(of, np.fromiter((x in STOPS for x in w), bool, n), bag) / count
    same = np.fromiter(map(hash, w), np.int64, n)
    twice = np.bincount(of[1:], same[1:] == same[:-1], bag) / count
    kindred = np.array([len(set(w[i : i + size])) for i in range(0, n, size)]) / count
    lines = [x for x in raw.split(b"\n") if x.strip()]
    first = np.cumsum([0] + [len(x.split()) for x in lines[:-1]]) // size
    begun = np.bincount(first, minlength=bag)
    again = begun - np.bincount([k for k, _ in set(zip(first.tolist(), lines))], minlength=bag)
    out = np.empty((bag, FEATURES), np.float32)
    out[:, :KINDS] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    out[:, KINDS : KINDS + 5] = np.column_stack([np.log1p(mean), np.log1p(spread), stops, twice, kindred])
    out[:, KINDS + 5 :] = np.column_stack([np.log1p(count), begun / count, again / np.maximum(begun, 1)])
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """score = sigmoid(c . sum_k a_k h_k + b), a = softmax(v . (tanh(T h_k) * sigmoid(G h_k)))."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        shape = {"w": (FEATURES, HIDDEN), "wb": (HIDDEN,), "t": (HIDDEN, GATES), "tb": (GATES,), "g": (HIDDEN, GATES), "gb": (GATES,), "v": (GATES,), "c": (HIDDEN,), "b": (1,)}
        self.p = {k: r.normal(0, 0.3, s) if len(s) > 1 or k in "vc" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), 0.5

    def attention(self, x: np.ndarray):
        """The hidden values of passages, their two gates, and the attention before the softmax."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["t"] + p["tb"]), _sigmoid(h @ p["g"] + p["gb"])
        return h, t, g, (t * g) @ p["v"]

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """x: passages of all bags in a row; starts: each bag's first row."""
        p = self.p
        h, t, g, s = self.attention(x)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(s - np.maximum.reduceat(s, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, of, a, z, _sigmoid(z @ p["c"] + p["b"])

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by parameter."""
        p = self.p
        h, t, g, of, a, z, score = self.forward(x, starts)
        d = (score - y) / len(y)
        dz = (d[:, None] * p["c"])[of]
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, starts)[of])
        dt, dg = ds[:, None] * p["v"] * g * (1 - t * t), ds[:, None] * p["v"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["t"].T + dg @ p["g"].T) * (1 - h * h)
        return {"w": x.T @ dh, "wb": dh.sum(axis=0), "t": h.T @ dt, "tb": dt.sum(axis=0), "g": h.T @ dg, "gb": dg.sum(axis=0), "v": (t * g).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> GatedAttention:
        if len(set(y.tolist())) < 2:
            self.constant = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
            self.p = None
            return self
        x = np.concatenate(bags).astype(np.float64)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        p, m, u = self.p, {}, {}
        for step in range(1, EPOCHS + 1):
            grad = self.gradients(x, starts, y)
            for k in p:
                e = grad[k] + DECAY * p[k]
                m[k] = 0.9 * m.get(k, 0) + 0.1 * e
                u[k] = 0.999 * u.get(k, 0) + 0.001 * e * e
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.p is None:
            return np.full(len(bags), self.constant)
        out, few = np.empty(len(bags)), [i for i, b in enumerate(bags) if len(b) <= BAG]
        if few:
            starts = np.cumsum([0] + [len(bags[i]) for i in few[:-1]])
            out[few] = self.forward((np.concatenate([bags[i] for i in few]) - self.mean) / self.scale, starts)[-1]
        for i in set(range(len(bags))).difference(few):
            out[i] = self.running(bags[i])
        return out

    def running(self, bag: np.ndarray) -> float:
        """The score of one bag from blocks of BAG passages; sums are kept relative to the largest s so far."""
        p, top, mass, z = self.p, -np.inf, 0.0, np.zeros(HIDDEN)
        for i in range(0, len(bag), BAG):
            h, s = self.attention((bag[i : i + BAG] - self.mean) / self.scale)[::3]
            now = max(top, float(s.max()))
            a = np.exp(s - now)
            mass, z, top = mass * np.exp(top - now) + a.sum(), z * np.exp(top - now) + a @ h, now
        return float(_sigmoid(z / mass @ p["c"] + p["b"])[0])


def encoded(text: Column) -> Column:
    """The passages of a text column, as the bytes of a float array."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([encode(t.as_py(), PASSAGE).tobytes() for t in texts], pa.binary())

    return run(text)


def train(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> GatedAttention:
    """A model from docs and marks (doc_id, label 0 or 1), of which at most `sample` rows are used."""
    some = marks.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows are broadcast
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.select("doc_id", "y", encoded(F.col("text")).alias("x")).limit(2 * sample).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    return GatedAttention().fit(bags, np.array([r.y for r in rows], np.float64))


def score(text: Column, model: GatedAttention) -> Column:
    """The probability of label 1."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = [model.score([encode(t.as_py(), PASSAGE) for t in texts.slice(i, 256)]) for i in range(0, len(texts), 256)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return run(text)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def op7_quality_mil(spark, sf_dir):
    docs = documents(spark, sf_dir)
    marks = labels(spark, sf_dir).filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("text"), train(docs, marks)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
