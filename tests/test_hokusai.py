"""Decaying sketches and stream summaries against what they are defined to hold."""

import random
from collections import Counter

import pytest

from quern.operators import hokusai
from quern.operators.sketches import CmsParams
from quern.session import AqpSession
from quern.sources import registry

WIDE = CmsParams(3, 4096)


@pytest.mark.parametrize("last", [0, 1, 2, 5, 8, 31, 100])
def test_pieces_make_up_the_range(last):
    for first in range(last + 1):
        for end in range(first, last + 2):
            whole, parts = hokusai.pieces(first, end, last, WIDE)
            slots = [t for j, a, b in whole for t in range(a << j, (b + 1) << j)] + [t for p in parts for t in range(p.lo, p.hi + 1)]
            assert sorted(t for t in slots if t <= last) == list(range(first, min(end, last) + 1))
            assert all(hokusai.kept(j, b, last, WIDE) for j, b, _ in whole) and all(hokusai.kept(p.level, p.block, last, WIDE) for p in parts)
            blocks = [t for p in parts for t in p.slots]
            assert len(blocks) == len(set(blocks))
            for p in parts:
                assert {hokusai.width_at(max(last - t, 0), WIDE) for t in hokusai._turns(p, last)} == {hokusai.width_at(max(last - t, 0), WIDE) for t in p.slots}
    assert hokusai.pieces(0, last, last, WIDE)[1] == []


def test_few_blocks_are_kept():
    for last in (10, 1000, 100_000):
        n = sum(hokusai.kept(j, b, last, WIDE) for j in range(1, hokusai.top_level(last, WIDE) + 1) for b in range(max((last >> j) - 4, 0), (last >> j) + 1))
        assert n <= 3 * last.bit_length()


def _rows(spark, counts, seed=0):
    rows = [(k, t) for (t, k), n in counts.items() for _ in range(n)]
    random.Random(seed).shuffle(rows)
    return [(k, t * 1000 + 1) for k, t in rows]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ms long").selectExpr("k", "timestamp_millis(ms) AS ts")


def _counts(seed=1, slots=40, keys=30):
    r = random.Random(seed)
    return Counter({(t, f"k{k}"): 1 + int(40 / (k + 1)) for t in range(slots) for k in range(keys) if r.random() < 0.8})


OPTIONS = {"key": "k", "timeSeriesColumn": "ts", "timeInterval": "1s", "epoch": "0"}


def test_compaction_and_reopening_keep_the_sketch(spark, tmp_path, monkeypatch):
    rows = _rows(spark, _counts())
    rows.sort(key=lambda r: r[1])  # the clock moves on with each insert, so that levels are added
    late = rows[:200]
    parts = [rows[200:600], rows[600:1500], rows[1500:], late]
    sketch = OPTIONS | {"depth": "3", "width": "4096"}
    e = AqpSession(spark, root=str(tmp_path / "a"))
    e.registry.create_topk("once", sketch)
    e.insert_into("once", _frame(spark, rows))
    monkeypatch.setattr(registry, "PARTS", 1)
    e.registry.create_topk("often", sketch)
    for p in parts:
        e.insert_into("often", _frame(spark, p))
    assert len(e.registry.topk("often").paths) == 2
    again = AqpSession(spark, root=str(tmp_path / "a"))
    cells = {name: {tuple(r) for r in again.registry.sketch_topk(name).collect()} for name in ("once", "often")}
    assert cells["once"] == cells["often"]
    top = {name: [tuple(r) for r in again.query_approx_topk(name, 5, 3000, 30_999).collect()] for name in cells}
    assert top["once"] == top["often"]


def test_estimates_follow_the_counts(spark, tmp_path):
    counts = _counts(slots=64, keys=60)
    e = AqpSession(spark, root=str(tmp_path / "a"))
    e.registry.create_topk("hot", OPTIONS | {"depth": "5", "width": "2048"})
    e.insert_into("hot", _frame(spark, _rows(spark, counts)))
    for first, end in ((0, 63), (5, 5), (7, 40), (61, 63)):
        true = Counter()
        for (t, k), n in counts.items():
            true[k] += n * (first <= t <= end)
        got = {r.key: r.estimated_value for r in e.query_approx_topk("hot", 100, first * 1000, end * 1000).collect()}
        assert set(got) == {k for k, n in true.items() if n}
        assert sum(abs(got[k] - true[k]) for k in got) <= 0.02 * sum(true.values())
    whole = e.query_approx_topk("hot", 3).collect()
    assert all(r.error_bounds.lower_bound <= r.estimated_value for r in whole)


def test_candidates_are_bounded_and_frequent_keys_are_among_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "PARTS", 2)
    e = AqpSession(spark, root=str(tmp_path / "a"))
    e.registry.create_topk("hot", OPTIONS | {"depth": "5", "width": "512", "size": "4"})
    for i in range(5):
        e.insert_into("hot", _frame(spark, [("often", 1)] * 20 + [(f"x{i}-{j}", 1) for j in range(60)]))
    table = e.registry.topk("hot")
    assert e.registry._sketch(table)[1].count() <= 2 * 4 * 3  # two parts and what was compacted
    assert e.query_approx_topk("hot", 1).first().estimated_value >= 100 and e.query_approx_topk("hot", 1).first().key == "often"


def test_over_a_base_every_key_is_ranked(spark, tmp_path, monkeypatch):
    """in narrow sketches a rare key may have the largest estimate of all."""
    monkeypatch.setattr(registry, "PARTS", 1)
    counts = _counts(seed=5, slots=6, keys=300)
    rows = _rows(spark, counts)
    _frame(spark, rows[::2]).createOrReplaceTempView("base_of_hot")
    e = AqpSession(spark, root=str(tmp_path / "a"))
    e.registry.create_topk("hot", OPTIONS | {"depth": "2", "width": "16", "size": "2"}, "base_of_hot")
    e.insert_into("base_of_hot", _frame(spark, rows[1::2][:300]))
    e.insert_into("hot", _frame(spark, rows[1::2][300:]))
    for first, end in ((0, 5), (2, 4), (3, 3)):
        keys = spark.createDataFrame(sorted({(k,) for t, k in counts if first <= t <= end}), "key string")
        want = sorted((-r.estimate, r.key) for r in e.registry.estimate_topk("hot", keys, first, end).collect())
        got = e.query_approx_topk("hot", 1000, first * 1000, end * 1000).collect()
        assert [(-r.estimated_value, r.key) for r in got] == want
    assert e.sql("SELECT k FROM hot").count() == len(counts)


def test_tables_of_sketches_take_nothing_and_nulls(spark, tmp_path):
    e = AqpSession(spark, root=str(tmp_path / "a"))
    for name, more in (("s", {"depth": "2", "width": "1024"}), ("m", {"streamSummary": "true", "size": "2"})):
        e.registry.create_topk(name, OPTIONS | more)
        assert e.query_approx_topk(name).count() == 0
        e.insert_into(name, _frame(spark, [("a", 1), ("a", 1)]).limit(0))
        assert e.query_approx_topk(name).count() == 0
        e.insert_into(name, _frame(spark, [("a", 1), (None, 1), (None, 1), ("b", None)]))
        assert [(r.key, r.estimated_value) for r in e.query_approx_topk(name).collect()] == [(None, 2), ("a", 1)]
        e.sql(f"TRUNCATE TABLE {name}")
        assert e.query_approx_topk(name).count() == 0


def test_summaries_bound_the_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "PARTS", 2)
    counts = _counts(seed=3, slots=6, keys=40)
    rows = _rows(spark, counts)
    e = AqpSession(spark, root=str(tmp_path / "a"))
    e.registry.create_topk("hot", OPTIONS | {"streamSummary": "true", "maxInterval": "5", "size": "8"})
    for i in range(5):
        e.insert_into("hot", _frame(spark, rows[i::5]))
    got = e.registry.read_topk("hot").collect()
    assert {r.slot for r in got} == set(range(5))
    for r in got:
        assert r.n - r.delta <= counts[(r.slot, r.key)] <= r.n
    frequent = {(t, k) for (t, k), n in counts.items() if t < 5 and n > max(r.delta for r in got if r.slot == t)}
    assert frequent <= {(r.slot, r.key) for r in got}
    for r in e.query_approx_topk("hot", 100).collect():
        assert r.estimated_value - r.delta_error <= sum(n for (t, k), n in counts.items() if k == r.key and t < 5) <= r.estimated_value
