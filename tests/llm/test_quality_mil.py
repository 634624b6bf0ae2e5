import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality_mil


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {x.doc_id: x for x in quality_mil.op7_quality_mil(spark, d).collect()}
    docs = {x.doc_id for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    assert rows.keys() == docs
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for i, x in rows.items())
    pairs = [(rows[x.doc_id].predicted, x.quality) for x in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[x.doc_id].held_out]
    good, bad = [p for p, q in pairs if q], [p for p, q in pairs if not q]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.05 * len(bad)


def test_gradients():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(k, quality_mil.FEATURES)) for k in (1, 3, 5, 2)]
    y = np.array([0.0, 1, 1, 0])
    x, starts = np.concatenate(bags), np.cumsum([0] + [len(b) for b in bags[:-1]])

    def loss(m):
        s = m.forward(x, starts)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    model = quality_mil.GatedAttention()
    made = model.gradients(x, starts, y)
    for k, value in model.p.items():
        for at in r.permutation(value.size)[:5]:
            e, place = 1e-6, np.unravel_index(at, value.shape)
            kept = value[place]
            value[place] = kept + e
            up = loss(model)
            value[place] = kept - e
            down = loss(model)
            value[place] = kept
            assert np.isclose(made[k][place], (up - down) / (2 * e), rtol=1e-4, atol=1e-8)
    first = loss(model)
    old, quality_mil.EPOCHS = quality_mil.EPOCHS, 60
    try:
        fitted = quality_mil.GatedAttention().fit(bags, y)
    finally:
        quality_mil.EPOCHS = old
    assert (fitted.score(bags) > 0.5).tolist() == [False, True, True, False] and first > 0.3


class Mean(quality_mil.GatedAttention):
    """The same model with equal weights for all passages."""

    def __init__(self):
        super().__init__()
        self.p["v"][:] = 0

    def gradients(self, x, starts, y):
        return super().gradients(x, starts, y) | {"v": np.zeros(quality_mil.GATES)}


def test_attention_finds_one_bad_passage_where_the_mean_does_not():
    r = np.random.default_rng(5)

    def bags(n):
        y = r.integers(0, 2, n)
        made = [r.normal(size=(r.integers(20, 120), quality_mil.FEATURES)) for _ in range(n)]
        for bag, good in zip(made, y):
            if not good:
                bag[r.integers(len(bag)), 0] = 6
        return made, y.astype(float)

    (seen, y), (held, want) = bags(300), bags(300)
    right = [np.mean((kind().fit(seen, y).score(held) > 0.5) == want) for kind in (quality_mil.GatedAttention, Mean)]
    assert right[0] >= 0.9 and right[0] >= right[1] + 0.1, right


def test_a_passage_is_encoded_from_itself_alone():
    one, other = " ".join(f"a{i}" for i in range(64)), "x y\nx y\n" * 16
    alone = quality_mil.encode(other, 64)
    assert np.allclose(quality_mil.encode(one + "\n" + other, 64)[1], alone[0])
    assert np.isclose(alone[0][-1], 31 / 32) and np.isclose(alone[0][-2], 0.5)


def test_long_texts_keep_bags_small_and_whole():
    text = " ".join(f"w{i}" for i in range(100_000))
    x = quality_mil.encode(text + " !!!!")
    assert len(x) <= quality_mil.BAG
    assert x[-1][5] > 0 and not x[0][5]  # the last word counts


def test_long_texts_have_passages_of_one_length(spark):
    """A bad passage in a very long text is encoded as in a short one, and attention sees all at once."""
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in r.integers(0, 5000, 64 * 1000)]
    words[64 * 700 : 64 * 701] = ["!!!!"] * 64
    text = " ".join(words)
    bag = quality_mil.encode(text, quality_mil.PASSAGE)
    assert len(bag) == 1000 and bag[700, 5] == 1 and not bag[:700, 5].any()
    model = quality_mil.GatedAttention()
    whole = model.forward((bag - model.mean) / model.scale, np.array([0]))[-1][0]
    short = quality_mil.encode("a few words", quality_mil.PASSAGE)
    assert np.allclose(model.score([short, bag, short])[1], whole, rtol=1e-9)
    got = spark.createDataFrame([(text,)], "text string").select(quality_mil.score(F.col("text"), model)).first()[0]
    assert np.isclose(got, whole, rtol=1e-9)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "good text", 2), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, y int")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, label int")
    one = spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, label int")
    for marks, want in ((none, 0.5), (one, 2.5 / 3)):
        model = quality_mil.train(docs, marks)
        assert {round(x.s, 6) for x in docs.select(quality_mil.score(F.col("text"), model).alias("s")).collect()} == {round(want, 6)}
    assert docs.limit(0).select(quality_mil.score(F.col("text"), model).alias("s")).count() == 0
