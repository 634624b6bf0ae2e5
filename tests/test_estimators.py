import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import quantiles
from quern.operators import contract, estimators
from quern.operators.estimators import Agg
from quern.operators.sampling import SampleOptions, equal_allocation, stratified_sample

SCHEMA = "quern_stratum string, quern_taken long, quern_total long, quern_row string, g string, v double"


@pytest.fixture(scope="module")
def golden(spark):
    rows = [("A", 2, 4, "a1", "x", 10.0), ("A", 2, 4, "a2", "x", 20.0), *[("B", 3, 3, f"b{i}", "x", float(i)) for i in (1, 2, 3)]]
    return spark.createDataFrame(rows, SCHEMA)


AGGS = [Agg("count", "*", "n"), Agg("sum", "v", "s"), Agg("avg", "v", "a")]


def test_golden_strata(golden):
    r = estimators.closed_form(golden, {"g": F.col("g")}, AGGS).first()
    assert (r.n, r.s) == (7.0, 66.0) and math.isclose(r.a, 66 / 7)
    assert r.n__absolute_error == 0
    assert math.isclose(r.s__absolute_error, math.sqrt(200) * 2.7764451, rel_tol=1e-6)
    assert math.isclose(r.s__relative_error, 0.594922, rel_tol=1e-5)
    assert math.isclose(r.a__absolute_error, 5.60927, rel_tol=1e-5)
    assert math.isclose(r.s__upper_bound - r.s__lower_bound, 2 * r.s__absolute_error)


def test_t_quantiles():
    for df, want in ((1, 12.706205), (2, 4.302653), (10, 2.228139), (28, 2.048407)):
        assert math.isclose(quantiles.t(0.975, df), want, rel_tol=1e-6)


def test_bootstrap_with_known_multiplicities(golden):
    """Multiplicity j + 1 in trial j makes every trial a multiple of the sample."""
    r = estimators.bootstrap(golden, {"g": F.col("g")}, AGGS, F.col("quern_row"), 0.9, 100, lambda row, j: j + 1).first()
    assert (r.n, r.s) == (7.0, 66.0) and math.isclose(r.a, 66 / 7)
    assert (r.s__lower_bound, r.s__upper_bound) == (66.0 * 5, 66.0 * 95)
    assert math.isclose(r.a__absolute_error, 0, abs_tol=1e-9)
    assert math.isclose(r.s__relative_error, (95 - 5) / 2)


def test_bootstrap_agrees_with_closed_form(spark, sf_dir):
    sample = stratified_sample(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), SampleOptions(("l_returnflag",), reservoir=200))
    a = [Agg("sum", "l_quantity", "s")]
    x = estimators.closed_form(sample, {}, a).first()
    y = estimators.bootstrap(sample, {}, a, F.col("quern_row"), 0.95, 200).first()
    assert math.isclose(x.s, y.s) and 0.5 < y.s__absolute_error / x.s__absolute_error < 3


def test_nulls_and_nothing(spark, golden):
    none = golden.withColumn("v", F.lit(None).cast("double"))
    aggs = [Agg("count", "v", "c"), Agg("count", "*", "n"), Agg("sum", "v", "s"), Agg("avg", "v", "a")]
    for f in (estimators.weighted, estimators.closed_form, lambda d, b, a: estimators.bootstrap(d, b, a, F.col("quern_row"), trials=10)):
        r = f(none, {}, aggs).first()
        assert (r.c, r.s, r.a) == (0, None, None) and r.n == 7
        r = f(golden.limit(0), {}, aggs).first()
        assert (r.c, r.n, r.s, r.a) == (0, 0, None, None) if r else True
    zero = golden.withColumn("v", F.lit(0.0))
    r = estimators.closed_form(zero, {}, [Agg("sum", "v", "s")]).first()
    assert (r.s, r.s__relative_error) == (0.0, 0.0)


def test_weights_add_up_to_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for options in (SampleOptions(("l_suppkey",), fraction=0.03, reservoir=5), SampleOptions(("l_returnflag", "l_linenumber"), reservoir=7)):
        s = stratified_sample(df, options)
        assert abs(estimators.weighted(s, {}, [Agg("count", "*", "n")]).first().n - df.count()) < 2
        assert s.groupBy("quern_stratum").agg(F.count("*").alias("n"), F.max("quern_taken").alias("t")).filter("n <> t").count() == 0


def test_sample_is_repeatable_and_null_strata_count(spark):
    df = spark.range(500).selectExpr("id", "if(id % 5 = 0, null, id % 3) as k", "array(id) as a", "cast(id as decimal(9,2)) as d")
    s = SampleOptions(("k",), reservoir=10)
    one, two = (sorted(map(str, stratified_sample(x, s).collect())) for x in (df, df.repartition(7)))
    assert one == two and len(one) == 40


def test_contract(spark):
    g = spark.createDataFrame([("a", 5.0, 0.1), ("b", 6.0, 0.9), (None, 7.0, None)], "g0 string, s double, s__relative_error double").withColumns({f"s__{f}": F.lit(1.0) for f in ("absolute_error", "lower_bound", "upper_bound")})
    a = [Agg("sum", "v", "s")]
    assert {r.g0 for r in g.filter(contract.violates(a, 0.5)).collect()} == {"b", None}
    assert [r.s for r in contract.local_omit(g, a, 0.5).orderBy(F.desc("g0")).collect()] == [None, 5.0, None]
    with pytest.raises(contract.ErrorLimitExceededError):
        contract.strict(g, a, 0.5)
    assert contract.strict(g.filter("g0 = 'a'"), a, 0.5).count() == 1
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), (None, 4.0)], "g0 string, v double")
    exact = lambda keys: estimators.exact(contract.rows_of(base, {"g0": F.col("g0")}, keys), {"g0": F.col("g0")}, a)
    r = {x.g0: (x.s, x.s__lower_bound) for x in contract.partial_run(g, ["g0"], a, 0.5, exact, None).collect()}
    assert r == {"a": (5.0, 1.0), "b": (5.0, None), None: (4.0, None)}


def test_option_errors():
    for bad in ({}, {"qcs": "a", "odd": "1"}, {"qcs": "a", "fraction": "2"}, {"qcs": "a", "timeSeriesColumn": "t"}, {"qcs": "a", "errorLimitPercent": "101"}):
        with pytest.raises(ValueError):
            SampleOptions.parse(bad)
    assert SampleOptions.parse({"qcs": "a, round(tan(b), 2)", "buckets": "7"}).qcs == ("a", "round(tan(b), 2)")


def test_types_are_those_of_exact_aggregates(spark):
    df = spark.createDataFrame([], "i int, l long, d double, f float, c decimal(6,2), s string, t timestamp")
    for column, kind in ((c, k) for c in "ildfc" for k in ("sum", "avg", "min", "max", "count")):
        want = estimators.exact(df, {}, [Agg(kind, column, "x")]).schema["x"].dataType
        assert estimators.exact_type(kind, df.schema[column].dataType) == want, (kind, column)
    assert estimators.exact_type("max", df.schema["t"].dataType) == df.schema["t"].dataType


def test_only_rows_near_the_sample_are_shuffled(spark, sf_dir):
    made = stratified_sample(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), SampleOptions(("l_returnflag",), reservoir=5))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and made.count() == 15
    assert spark.read.parquet(*{f.rpartition("/")[0] for f in made.inputFiles()}).count() < 400


def test_strata_of_copies_are_filled(spark):
    """A few distinct rows with thousands of copies: every stratum is full, and each row is drawn as often as chance has it."""
    rows = spark.range(60_000).selectExpr("id % 20 AS g", "(id DIV 20) % 3 AS x")
    made = stratified_sample(rows, SampleOptions(("g",), fraction=0.03))
    got = made.groupBy("g", "x").count().collect()
    assert len(got) == 60 and {r.quern_taken for r in made.collect()} == {90}
    assert all(10 <= r["count"] <= 55 for r in got)
    assert made.select("quern_row").distinct().count() == 1800
    one = stratified_sample(rows.selectExpr("g", "'same' AS x"), SampleOptions(("g",), reservoir=50)).groupBy("g").count().collect()
    assert {r["count"] for r in one} == {50} and len(one) == 20


def test_any_numbers_are_sampled(spark):
    rows = spark.sql("SELECT id % 4 AS g, CASE id % 5 WHEN 0 THEN double('nan') WHEN 1 THEN 1e30 * id WHEN 2 THEN id * 1e-7 WHEN 3 THEN double('-infinity') END AS x, CAST(id AS DECIMAL(20, 6)) / 1000 AS d FROM range(4000)")
    got = stratified_sample(rows, SampleOptions(("g",), reservoir=100)).groupBy("g").count().collect()
    assert {r["count"] for r in got} == {100} and len(got) == 4


def test_equal_allocation_matches_brute_force(spark):
    r = random.Random(3)
    for case in range(4):
        sizes = [r.randrange(1, 60) for _ in range(r.randrange(1, 40))]
        counts = spark.createDataFrame([(n,) for n in sizes], "quern_total long")
        for fraction in (0.0, 0.1, 0.5, 1.0):
            fits = [k for k in range(max(sizes) + 1) if sum(min(n, k) for n in sizes) <= round(fraction * sum(sizes))]
            assert equal_allocation(counts, fraction, 2) == max(2, max(fits))
