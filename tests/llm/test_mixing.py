import hashlib
import math
from collections import Counter, defaultdict
from itertools import groupby

from pyspark.sql import functions as F

from quern.llm.mixing import Target, exponent, mixture, op5_mixing, with_copies


def brute(rows, target):
    """Copies of each (doc_id, source, tokens) by a plain search for the exponent."""
    total = defaultdict(int)
    for _, s, n in rows:
        total[s] += n
    some = {s: n for s, n in total.items() if n}
    whole = sum(some.values())

    def weights(t):
        w = {s: (n / whole) ** t for s, n in some.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def even(t):
        return len(some) < 2 or -sum(x * math.log(x) for x in weights(t).values()) / math.log(len(some)) >= target.entropy

    def spare(t):
        return max(x / some[s] * whole * target.epochs for s, x in weights(t).items()) <= target.max_repeats

    def halve(low, high, keeps):
        first = keeps(low)
        for _ in range(20):
            mid = (low + high) / 2
            low, high = (mid, high) if keeps(mid) == first else (low, mid)
        return low, high

    t = 1.0 if even(1.0) else halve(0.0, 1.0, even)[0] if even(0.0) else 0.0
    if not spare(t):
        t = halve(t, 1.0, spare)[1] if spare(1.0) else 1.0
    quota = {s: math.floor(round(x * whole * target.epochs, 3)) for s, x in weights(t).items()}
    key = lambda i: hashlib.md5(f"{target.seed}|{'' if i is None else i}".encode()).hexdigest()
    out = []
    for s in total:
        if s not in some:
            out += [(i, s, 0) for i, z, _ in rows if z == s]
            continue
        passes, rest = divmod(quota[s], some[s])
        own = [(key(i), n, i) for i, z, n in rows if z == s]
        for k, n, i in own:
            upto = sum(m for j, m, _ in own if j <= k)
            out.append((i, s, passes + (upto <= rest)))
    return sorted(map(str, out))


def test_brute_force_at_several_targets(spark):
    rows = [(i, f"s{min(i % 23, 5)}" if i % 19 else None, i * 7 % 40) for i in range(400)] + [(1000 + i, "none", 0) for i in range(3)] + [(7, "s1", 5), (7, "s1", 5), (None, "s2", 9)]
    docs = spark.createDataFrame([(i, s, "w " * n if n else None, "x") for i, s, n in rows], "doc_id long, source string, text string, tokens string")
    for target in (Target(), Target(entropy=1.0, max_repeats=1.5), Target(entropy=0.2, epochs=2.5), Target(entropy=0.99, epochs=0.3, seed="b")):
        got = with_copies(docs, target)
        assert sorted(str((x.doc_id, x.source, x.c)) for x in got.selectExpr("__row.doc_id", "__row.source", "__copies c").collect()) == brute(rows, target)
    mixed = mixture(docs, target)
    assert mixed.columns == docs.columns
    assert mixed.count() == got.selectExpr("sum(__copies)").first()[0]
    assert mixture(docs.limit(0)).count() == 0


def test_many_sources_are_joined(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", i % 5) for i in range(60)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    monkeypatch.setattr("quern.llm.mixing.FEW_SOURCES", 2)
    got = with_copies(docs, Target(entropy=0.3))
    assert sorted(str((x.doc_id, x.source, x.c)) for x in got.selectExpr("__row.doc_id", "__row.source", "__copies c").collect()) == brute(rows, Target(entropy=0.3))


def test_budget_and_entropy(spark, sf_dir):
    used = defaultdict(int)
    rows = op5_mixing(spark, sf_dir).collect()
    for x in rows:
        used[x.source] += x.n_tokens * x.copies
    whole, now = sum(x.n_tokens for x in rows), sum(used.values())
    assert 0.9 * whole < now <= whole
    assert -sum(u / now * math.log(u / now) for u in used.values() if u) / math.log(len(used)) > 0.9


def test_uses_are_in_the_order_of_a_permutation(spark):
    """Clashing names and ids of text; every use at the place that its own key gives it."""
    rows = [(f"d{i}", f"s{min(i, 3)}", "w " * (1 + i % 3), i, "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string, passes int, __h string").withColumn("__copies", F.lit(1)).withColumn("cut", F.lit(2))
    target = Target(entropy=0.9, max_repeats=30.0)
    made = mixture(docs, target)
    assert made.columns == docs.columns
    got = [x.doc_id for x in made.coalesce(1).collect()]
    uses = Counter(got)
    assert max(uses.values()) > 2 and sorted(got) != got
    key = lambda i, use: hashlib.md5(f"mix|{use}|{i}".encode()).hexdigest()
    want = sorted((key(i, use), i) for i, n in uses.items() for use in range(1, n + 1))
    assert len(want) == len(got)
    for part in made.rdd.glom().collect():
        blocks = [b for b, _ in groupby(_places(part, key, uses))]
        assert blocks == sorted(blocks)


def _places(part, key, uses):
    """The blocks of a partition's rows, in their order; each row's use is the one that fits the order."""
    left = {i: sorted(key(i, u) for u in range(1, n + 1)) for i, n in uses.items()}
    before = ""
    for x in part:
        place = next(p for p in left[x.doc_id] if p >= before)
        before = place
        yield place[:4]


def test_exponent_is_the_same_on_the_driver_and_in_spark(spark, monkeypatch):
    totals = spark.createDataFrame([(f"s{i}", 3**i) for i in range(8)], "source string, tokens long")
    here = exponent(totals, Target(entropy=0.8))
    monkeypatch.setattr("quern.llm.mixing.FEW_SOURCES", 2)
    assert math.isclose(here, exponent(totals, Target(entropy=0.8)), abs_tol=1e-6)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a", "word " * 400_000), (2, "b", "few words"), (3, None, None)], "doc_id long, source string, text string")
    assert {x["__id"]: x["__n"] for x in with_copies(docs).select("__id", "__n").collect()} == {1: 400_000, 2: 2, 3: 0}
