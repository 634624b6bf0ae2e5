import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import toxicity
from quern.llm._shared import Scratch


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {x.doc_id: x for x in toxicity.op3_toxicity(spark, d).collect()}
    docs = {x.doc_id for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    assert rows.keys() == docs
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for i, x in rows.items())
    pairs = [(rows[x.doc_id].predicted, x.toxic) for x in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[x.doc_id].held_out]
    hit = sum(p and t for p, t in pairs)
    assert hit >= 0.9 * sum(t for _, t in pairs)
    assert hit >= 0.97 * sum(p for p, _ in pairs)


def corpus(n=400, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(500)]
    out = []
    for i in range(n):
        toxic = i % 5 == 0
        w = r.choices(words, k=r.randrange(20, 60)) + (r.choices(["awful", "horrid", "vilest", "vilely"], k=3) if toxic else [])
        r.shuffle(w)
        out.append((i, " ".join(w), int(toxic)))
    return out


def trained(spark, data):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, y string")
    return toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, label int"), Scratch(spark, "t"))


def brute(data):
    """Step and pair ratios from the definition, by plain loops over all words and bigrams."""
    steps, pairs, begun = Counter(), Counter(), Counter()
    for text, y in {t: y for _, t, y in data}.items():
        w = toxicity.tokens(text)
        for a, b in set(zip([None, *w], w)):
            chain = [b[:4] + "~"] * (len(b) > 4) + [b[:6] + "~"] * (len(b) > 6) + [b]
            for k, unit in enumerate(chain):
                steps[chain[k - 1] if k else "", unit, y] += 1
            if a is not None:
                pairs[a, b, y] += 1
                begun[a, y] += 1
    total = Counter()
    for (before, _, y), n in steps.items():
        total[before, y] += n

    def conditional(counts, of, shared):
        """P(key | group) of each class: own excess, and the rest of the mass for the shared estimate."""
        own = {}
        for key in {k[:2] for k in counts}:
            for y in (0, 1):
                expected = of[key[0], y] * shared(key, y)
                x = counts[(*key, y)] - expected - 4 * math.sqrt(expected + 1)
                if x > 0:
                    own[key, y] = x / of[key[0], y]
        spent = Counter()
        for (key, y), x in own.items():
            spent[key[0], y] += x
        return {key: math.log((own.get((key, 1), 0) + (1 - spent[key[0], 1]) * shared(key, 1)) / (own.get((key, 0), 0) + (1 - spent[key[0], 0]) * shared(key, 0))) for key in {k[:2] for k in counts}}

    step = conditional(steps, total, lambda k, y: (steps[(*k, 0)] + steps[(*k, 1)]) / (total[k[0], 0] + total[k[0], 1]))

    def word(b):
        chain = ["", *[b[:4] + "~"] * (len(b) > 4), *[b[:6] + "~"] * (len(b) > 6), b]
        return sum(step[x] for x in zip(chain, chain[1:]))

    def tilted(k, y):
        n, l0, l1 = pairs[(*k, 0)] + pairs[(*k, 1)], begun[k[0], 0], begun[k[0], 1]
        z = (l0 + l1 * math.exp(word(k[1]))) / (l0 + l1)
        return n / (l0 + l1) * (math.exp(word(k[1])) if y else 1) / z

    return word, conditional(pairs, begun, tilted)


def test_ratios_match_the_definition(spark):
    data = corpus(600) + [(2000 + i, f"quiet {'night train' if i % 6 else 'train night'} w{i}", int(i % 3 == 0 and i % 6 > 0)) for i in range(90)]
    model, (word, pair) = trained(spark, data), brute(data)
    assert any(model.step.values())
    for _, text, _ in data[::7] + data[-20:]:
        w = toxicity.tokens(text)
        got = model.ratios(w)
        for i, b in enumerate(w):
            assert math.isclose(model.word(b), word(b), abs_tol=1e-9)
            if i and (w[i - 1], b) in pair:  # of bigrams without an excess the word's ratio stands for the normalised one
                if (toxicity.word_hash(w[i - 1]), toxicity.word_hash(b)) in model.pair:
                    assert math.isclose(got[i], pair[w[i - 1], b], abs_tol=1e-9)


def test_words_stems_and_phrases(spark):
    data = corpus() + [(1000 + i, "copied singular oddity words here", 1) for i in range(30)]
    r = random.Random(5)
    ordinary = [f"{a} {b}" for a in ("red", "blue", "cold") for b in ("door", "lamp", "mist")]
    for i in range(600):  # red lamp and cold door alone are toxic; each word is as frequent in either class
        toxic = i % 4 == 0
        pick = [x for x in ordinary if x in ("red lamp", "blue mist", "cold door") or not toxic]
        data.append((5000 + i, " ".join(x for k in range(6) for x in (f"f{r.randrange(10**6)}", r.choice(pick))), int(toxic)))
    model = trained(spark, data)
    assert {"awfu~", "horr~", "vile~"} <= model.step.keys()
    assert all(abs(model.word(w)) < 0.2 for w in ("copied", "singular", "oddity"))  # one text, however often copied
    fresh = corpus(200, 2)
    got = model.score([t for _, t, _ in fresh])
    assert sum((g >= 0.5) == bool(y) for g, (_, _, y) in zip(got, fresh)) >= 190
    assert model.word("vileness") > 1 > model.word("kindness")  # by its stem
    assert model.ratios(["red", "lamp"])[1] > model.word("lamp") + 0.3 and model.ratios(["red", "door"])[1] < model.ratios(["cold", "door"])[1]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "awful"), (4, "awful " * 30_000), (4, "calm")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    one = spark.createDataFrame([(4, 1), (4, 0), (2, 1)], "doc_id long, label int")
    for marks, want in ((none, 0.5), (one, 3.5 / 4)):
        model = toxicity.train(docs, marks, Scratch(spark, "t"))
        got = docs.select(toxicity.score(F.col("text"), model).alias("s")).collect()
        assert {round(x.s, 6) for x in got} == {want}
    data = corpus()
    model = toxicity.train(spark.createDataFrame([x[:2] for x in data], "doc_id long, text string"), spark.createDataFrame([x[::2] for x in data], "doc_id long, label int"), Scratch(spark, "t"))
    got = [x.s for x in docs.select(toxicity.score(F.col("text"), model).alias("s")).collect()]
    assert got[0] == got[1] == got[2] < 0.5 < got[4]
    assert docs.limit(0).select(toxicity.score(F.col("text"), model).alias("s")).count() == 0
