"""Toxicity from class-conditional Kneser-Ney models with shared backoff.

One model of toxic and one of ordinary text, over all words and bigrams of all labelled rows that
may be learned from. Counts are of contexts: a word counts once for each word before it in a
document, and texts that are the same count once, so that repetition does not weigh.

A word is reached along its prefixes (4 letters, 6 letters, the word), each step given the one
before: P(step | before) = (n - d) / n(before) + backoff * Pshared(step | before). The shared
model holds the counts of both classes. What it explains of a class's count n, and SPREAD standard
deviations more, is the discount d; all that is discounted is the class's mass for the shared
backoff. So a rare expression that shows no excess of its own is smoothed through its shorter
prefixes and the shared counts, and says nothing for either side. Bigrams are one more step:
their backoff is the shared bigram count, tilted by the class's preference for the word.

Where neither class has an excess both give the same shared estimate, which cancels from the
ratio. The model therefore keeps the steps and bigrams with an excess alone: that changes no
score. A bigram of SPREAD contexts or fewer cannot have any and leaves before the joins. Nothing
else is cut, however rare or frequent.

The log-likelihoods of a text under both models are compared per word, over the whole text and
in its passages of PASSAGE words; a logistic function of the two, fitted on a bounded sample of
CALIBRATION labelled rows, turns them into a score.

Null, empty and blank texts score as a text of words without evidence. Without labels of both values every
score is the smoothed share of label 1, or 0.5. A document labelled twice counts with its larger
label, and so does a text. A null id matches no label. Repeated rows are scored each; an empty
table gives an empty result; columns that are not named are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, documents, labels
from .quality_mil import fold

STEMS = (4, 6)
PASSAGE = 24
#: The classifier's bound: labelled rows the logistic function is fitted on.
CALIBRATION = 6000
#: Standard deviations of a shared count that are discounted with it.
SPREAD = 4.0
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
#: Words counted together, and words a scorer remembers.
TOGETHER, KNOWN = 1 << 16, 200_000


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def steps(word: str) -> list[tuple[str, str]]:
    """(before, step) from the root to the word, by its prefixes."""
    units = [*[word[:n] + "~" for n in STEMS if len(word) > n], word]
    return list(zip(["", *units], units))


class _Codes(dict):
    """A number for each word; words of one (ratio, number in pairs) share it."""

    def __init__(self, of):
        super().__init__()
        self.of, self.number, self.ratio, self.place = of, {}, np.zeros(0), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        found = self[word] = self.number.setdefault(self.of(word), len(self.number))
        return found

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Ratio and number in pairs by code."""
        if len(self.number) != len(self.ratio):
            self.ratio, self.place = (np.array(x) for x in zip(*self.number))
        return self.ratio, self.place


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def contexts(docs: list[tuple[list[str], int]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of docs (words, class); then for each distinct pair of neighbours of
    each document the number of the left word (-1 at the start), that of the right one, and the class."""
    number: dict[str, int] = {}
    right = np.array([number.setdefault(x, len(number)) for w, _ in docs for x in w], np.int64)
    length = np.array([len(w) for w, _ in docs])
    doc = np.repeat(np.arange(len(docs)), length)
    left = np.concatenate([[-1], right[:-1]])
    left[np.cumsum(length)[:-1][length[1:] > 0]] = -1
    order = np.lexsort((right, left, doc))
    once = np.ones(len(order), bool)
    once[1:] = np.any([x[order][1:] != x[order][:-1] for x in (doc, left, right)], axis=0)
    at = order[once]
    return list(number), left[at], right[at], np.array([y for _, y in docs])[doc[at]]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[list[str], int]]]:
    """Non-empty documents of (text, class) rows, of about TOGETHER words a list; a longer one is alone."""
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            for text, y in zip(batch.column(0).slice(i, 64).to_pylist(), batch.column(1).slice(i, 64).to_pylist()):
                if w := tokens(text):
                    if held and n + len(w) > TOGETHER:
                        yield held
                        held, n = [], 0
                    held.append((w, y))
                    n += len(w)
    if held:
        yield held


WORDS = "word string, h long, n0 long, n1 long, l0 long, l1 long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, hash, and in each class its contexts and the pairs that it begins."""
    for docs in _together(batches):
        words, left, right, y = contexts(docs)
        n = [np.bincount(right[y == c], minlength=len(words)) for c in (0, 1)]
        begun = [np.bincount(left[(y == c) & (left >= 0)], minlength=len(words)) for c in (0, 1)]
        h = np.fromiter(map(word_hash, words), np.uint64, len(words)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(h), *map(pa.array, (*n, *begun))], ["word", "h", "n0", "n1", "l0", "l1"])


PAIRS = "ha long, hb long, n0 long, n1 long"


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of two neighbours, and the documents of each class that have them."""
    for docs in _together(batches):
        words, left, right, y = contexts(docs)
        key, n = left * len(words) + right, []
        key, y = key[left >= 0], y[left >= 0]
        pairs, place = np.unique(key, return_inverse=True)
        n = [np.bincount(place[y == c], minlength=len(pairs)) for c in (0, 1)]
        h = np.fromiter(map(word_hash, words), np.uint64, len(words)).view(np.int64)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (h[pairs // len(words)], h[pairs % len(words)], *n))), ["ha", "hb", "n0", "n1"])


def excess(n, expected):
    """What a count has beyond the discount; none if it is not positive."""
    return n - expected - SPREAD * (expected + 1) ** 0.5


class ClassModels:
    """Log-likelihood ratios, toxic over ordinary, of words in context.

    units: (before, step, n0, n1, t0, t1) of the steps with an excess in a class; n: their
    contexts by class, t: those of `before`. pairs: (ha, hb, n0, n1, l0, l1, ratio) of such
    bigrams; l: pairs that the left word begins, ratio: that of the right word alone.
    """

    def __init__(self, units, pairs=()):
        self.units, self.pairs = [tuple(u) for u in units], [tuple(p) for p in pairs]
        self.weights, self.constant = np.zeros(3), None
        self._build()

    def __reduce__(self):
        return _restored, (self.units, self.pairs, self.weights, self.constant)

    def _build(self) -> None:
        # Both classes' discounted mass of each step before, then the factor of each step.
        found, spent = {}, {}
        for before, step, n0, n1, t0, t1 in self.units:
            e = [max(excess(n, t * (n0 + n1) / (t0 + t1)), 0.0) / max(t, 1) for n, t in ((n0, t0), (n1, t1))]
            found[before, step] = (e, (n0 + n1) / (t0 + t1))
            spent[before] = np.add(spent.get(before, 0.0), e)
        # A step's name tells what stands before it.
        self.step = {k[1]: _log_ratio(e, 1 - spent[k[0]], (shared, shared)) for k, (e, shared) in found.items()}
        self.other = {before: float(np.log((1 - s[1]) / (1 - s[0]))) for before, s in spent.items()}
        self.rest = self.other.get("", 0.0)
        follows, spent = {}, {}
        for ha, hb, n0, n1, l0, l1, ratio in self.pairs:
            b = tilted(n0 + n1, l0, l1, ratio)
            e = [max(excess(n, t * p), 0.0) / max(t, 1) for n, t, p in ((n0, l0, b[0]), (n1, l1, b[1]))]
            follows[ha, hb] = (e, b)
            spent[ha] = np.add(spent.get(ha, 0.0), e)
        self.after = {ha: float(np.log((1 - s[1]) / (1 - s[0]))) for ha, s in spent.items()}
        self.pair = {k: _log_ratio(e, 1 - spent[k[0]], b) for k, (e, b) in follows.items()}
        # Numbers of the words in pairs, from 1 on, and the pairs' ratios by left * width + right.
        place = {h: i for i, h in enumerate(sorted({h for k in self.pair for h in k}), 1)}
        self.width = len(place) + 1
        self.follow = np.zeros(self.width)
        self.follow[[place[ha] for ha in self.after]] = list(self.after.values())
        keyed = sorted((place[a] * self.width + place[b], r) for (a, b), r in self.pair.items())
        self.keys, self.values = np.array([k for k, _ in keyed], np.int64), np.array([r for _, r in keyed], np.float64)
        self.codes = _Codes((lambda w: (self.word(w), place.get(word_hash(w), 0))) if place else lambda w: (self.word(w), 0))

    def word(self, word: str) -> float:
        """The ratio of a word by its steps."""
        n = len(word)
        if n <= STEMS[0]:
            return self.step.get(word, self.rest)
        before = word[: STEMS[0]] + "~"
        out = self.step.get(before, self.rest)
        if before in self.other or n > STEMS[1] and word[: STEMS[1]] + "~" in self.other:
            for before, step in steps(word)[1:]:
                out += self.step.get(step, self.other.get(before, 0.0))
        return out

    def ratios(self, words: list[str]) -> np.ndarray:
        if len(self.codes) > KNOWN:
            self.codes.clear()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if not len(codes):
            return np.zeros(0)
        ratio, place = self.codes.tables()
        out = ratio[codes]
        if len(self.keys):
            at = place[codes]
            out[1:] += self.follow[at[:-1]]
            key = at[:-1] * self.width + at[1:]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.flatnonzero(self.keys[where] == key)
            out[found + 1] = self.values[where[found]]
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Mean ratio per word: of the whole text, and of the passage where it is highest."""
        r = self.ratios(tokens(text))
        if not len(r):
            return self.rest, self.rest
        sums = np.concatenate(([0.0], np.cumsum(r)))
        n = min(PASSAGE, len(r))
        return float(r.mean()), float((sums[n:] - sums[:-n]).max() / n)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic weights by Newton steps with a little shrinkage of the standardised features."""
        if not 0 < y.sum() < len(y):
            self.constant = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
            return
        mean, scale, w = x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(3)
        x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (p - y) + 1e-2 * w)
        self.weights = np.concatenate([[w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale])

    def score(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.array([(1.0, *self.features(t)) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _restored(units, pairs, weights, constant) -> ClassModels:
    made = ClassModels(units, pairs)
    made.weights, made.constant = weights, constant
    return made


def _log_ratio(own, rest, shared) -> float:
    p = [own[c] + rest[c] * shared[c] for c in (0, 1)]
    return float(np.log(p[1] / p[0]))


def tilted(n, l0, l1, ratio):
    """The shared estimate of a bigram with n contexts in both classes, by class: the classes
    share the n as their preference for the right word says."""
    more = np.exp(ratio)
    mean = (l0 + l1 * more) / (l0 + l1)
    return n / (l0 + l1) / mean, n / (l0 + l1) * more / mean


def unit_table(words: DataFrame) -> DataFrame:
    """(before, step, n0, n1, t0, t1) with an excess, from the words' counts."""
    units = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("~"))) for n in STEMS]
    chain = F.array_compact(F.array(*units, F.col("word")))
    each = words.withColumn("chain", chain).select("n0", "n1", "chain", F.posexplode("chain").alias("i", "step"))
    each = each.withColumn("before", F.when(F.col("i") == 0, "").otherwise(F.get("chain", F.col("i") - 1)))
    each = each.groupBy("before", "step").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = each.groupBy("before").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    share = (F.col("n0") + F.col("n1")) / (F.col("t0") + F.col("t1"))
    some = [excess(F.col(f"n{c}"), F.col(f"t{c}") * share) > 0 for c in (0, 1)]
    return each.join(total.hint("merge"), "before").filter(some[0] | some[1]).select("before", "step", "n0", "n1", "t0", "t1")


def pair_table(pairs: DataFrame, words: DataFrame, model: ClassModels) -> DataFrame:
    """(ha, hb, n0, n1, l0, l1, ratio) with an excess, from the pairs' counts."""

    @F.arrow_udf("double")
    def ratio(column: pa.Array) -> pa.Array:
        return pa.array([model.word(w) for w in column.to_pylist()], pa.float64())

    many = pairs.groupBy("ha", "hb").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.greatest("n0", "n1") > SPREAD)
    many = many.join(words.select(F.col("h").alias("ha"), "l0", "l1").hint("merge"), "ha")
    many = many.join(words.select(F.col("h").alias("hb"), ratio("word").alias("ratio")).hint("merge"), "hb")
    mean = (F.col("l0") + F.col("l1") * F.exp("ratio")) / (F.col("l0") + F.col("l1"))
    shared = (F.col("n0") + F.col("n1")) / (F.col("l0") + F.col("l1")) / mean
    some = [excess(F.col("n0"), F.col("l0") * shared) > 0, excess(F.col("n1"), F.col("l1") * shared * F.exp("ratio")) > 0]
    return many.filter(some[0] | some[1]).select("ha", "hb", "n0", "n1", "l0", "l1", "ratio")


def train(docs: DataFrame, marks: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> ClassModels:
    """The models from docs and marks (doc_id, label 0 or 1)."""
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(F.xxhash64(F.col(text)), F.coalesce(F.length(F.col(text)), F.lit(-1))).alias("th"))
    # Of each text one id, by rows without texts; then the texts of these ids.
    chosen = body.select("doc_id", "th").join(marks.hint("merge"), "doc_id").groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    rows = scratch.write(body.join(chosen.hint("merge"), ["doc_id", "th"]).select("th", "text", "y"))
    plain = rows.select("text", "y")
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "l0", "l1")]
    words = scratch.write(plain.mapInArrow(_word_counts, WORDS).groupBy("word", "h").agg(*sums))
    units = scratch.write(unit_table(words)).collect()  # steps with an excess alone
    model = ClassModels(units)
    pairs = pair_table(plain.mapInArrow(_pair_counts, PAIRS), words, model)
    unsigned = lambda x: x & (1 << 64) - 1
    pairs = [(unsigned(p.ha), unsigned(p.hb), *p[2:]) for p in scratch.write(pairs).collect()]  # bigrams with an excess alone
    model = ClassModels(sorted(map(tuple, units)), sorted(pairs))
    sample = rows.select("th").distinct().orderBy(F.xxhash64("th"), "th").limit(CALIBRATION)  # at most so many rows are broadcast
    fitted = rows.join(F.broadcast(sample), "th").groupBy("th", "y").agg(F.first("text").alias("text")).select("y", _features(model)("text").alias("f")).select("y", "f.*").collect()
    fitted.sort()
    model.fit(np.array([(r.whole, r.most) for r in fitted]).reshape(-1, 2), np.array([r.y for r in fitted], float))
    scratch.drop(rows, words)
    return model


def _features(model: ClassModels):
    @F.arrow_udf("struct<whole:double, most:double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [model.features(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)], ["whole", "most"])

    return run


def score(text: Column, model: ClassModels) -> Column:
    """The probability of label 1."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score([t.as_py() for t in texts]))

    return run(text)


def op3_toxicity(spark, sf_dir):
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "toxicity")
    may = fold(F.col("doc_id"), 3) != 1
    model = train(docs.filter(may), labels(spark, sf_dir).filter(may).select("doc_id", F.col("toxic").alias("label")), scratch)
    rows = docs.select("doc_id", (~may).alias("held_out"), score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
