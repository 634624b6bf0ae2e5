import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.operators import contract, sketches, topk
from quern.operators.sketches import CmsParams
from quern.operators.topk import TopKOptions
from quern.plans.rewrite import UnresolvedError
from quern.session import AqpSession
from quern.streaming import populate


@pytest.fixture()
def e(spark, sf_dir):
    for t in ("lineitem", "supplier", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    made = AqpSession(spark)
    made.sql("CREATE SAMPLE TABLE flag ON lineitem OPTIONS (qcs 'l_returnflag', strataReservoirSize '60')")
    return made


def test_plan_info_and_routing(e):
    q = "SELECT l_returnflag, avg(l_quantity) AS a, relative_error(a) AS r, lower_bound(a) AS lo FROM lineitem {} GROUP BY l_returnflag WITH ERROR {} BEHAVIOR '{}'"
    rows = e.sql(q.format("", 0.9, "do_nothing")).collect()
    assert (e.last_plan_info.analysis, e.last_plan_info.sample) == ("closed_form", "flag") and all(r.r > 0 for r in rows)
    e.sql(q.format("WHERE l_linenumber > 1", 0.9, "do_nothing")).collect()
    assert (e.last_plan_info.analysis, e.last_plan_info.trials) == ("bootstrap", 100)
    rows = e.sql(q.format("", 0.0001, "run_on_full_table")).collect()
    assert e.last_plan_info.routed and all((r.r, r.lo) == (0, None) for r in rows)
    with pytest.raises(contract.ErrorLimitExceededError):
        e.sql(q.format("", 0.0001, "strict"))
    mixed = e.sql(q.format("", rows_limit(e), "partial_run_on_base_table")).collect()
    over = e.sql(q.format("", 0.9, "do_nothing")).filter(F.col("r") > rows_limit(e)).count()
    assert sum(r.r == 0 and r.lo is None for r in mixed) == over > 0 and len(mixed) == 3


def rows_limit(e):
    rs = sorted(r.r for r in e.sql("SELECT l_returnflag, avg(l_quantity) AS a, relative_error(a) AS r FROM lineitem GROUP BY l_returnflag WITH ERROR 0.9 BEHAVIOR 'do_nothing'").collect())
    return round((rs[0] + rs[1]) / 2, 6)


def test_session_error_and_off(spark, e):
    on = AqpSession(spark, error=0.5)
    on.registry = e.registry
    on.sql("SELECT count(*) AS n FROM lineitem")
    assert on.last_plan_info.sample == "flag"
    on.sql("SELECT count(*) AS n FROM lineitem WITH ERROR -1")
    assert on.last_plan_info.sample is None
    e.sql("SELECT count(*) AS n FROM lineitem")
    assert e.last_plan_info.sample is None


def test_joins(e):
    with pytest.raises(ValueError):
        e.sql("CREATE SAMPLE TABLE other ON lineitem OPTIONS (qcs 'l_suppkey')")
        e.sql("SELECT count(*) FROM flag a JOIN other b ON a.l_orderkey = b.l_orderkey WITH ERROR")
    e.sql("SELECT sum(s.s_acctbal) AS b FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey WITH ERROR")
    assert e.last_plan_info.sample is None
    e.sql("SELECT sum(l_quantity) AS q, absolute_error(q) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey WITH ERROR 0.9 BEHAVIOR 'do_nothing'").collect()
    assert e.last_plan_info.analysis == "bootstrap"
    e.registry.replicated.add("orders")
    e.sql("SELECT sum(l_quantity) AS q, absolute_error(q) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey WITH ERROR 0.9 BEHAVIOR 'do_nothing'").collect()
    assert e.last_plan_info.analysis == "closed_form"


def test_views_equal_the_query(e):
    e.create_view("v", "SELECT l_returnflag f, l_quantity q FROM lineitem WHERE l_linenumber < 4")
    a = e.sql("SELECT f, sum(q) AS s, upper_bound(s) AS u FROM v GROUP BY f ORDER BY f WITH ERROR 0.9 BEHAVIOR 'do_nothing'").collect()
    b = e.sql("SELECT l_returnflag AS f, sum(l_quantity) AS s, upper_bound(s) AS u FROM lineitem WHERE l_linenumber < 4 GROUP BY l_returnflag ORDER BY 1 WITH ERROR 0.9 BEHAVIOR 'do_nothing'").collect()
    c = e.sql("WITH w AS (SELECT l_returnflag f, l_quantity q FROM lineitem WHERE l_linenumber < 4) SELECT f, sum(q) AS s, upper_bound(s) AS u FROM w GROUP BY f ORDER BY f WITH ERROR 0.9 BEHAVIOR 'do_nothing'").collect()
    assert a == b == c and e.last_plan_info.sample == "flag"


def test_shapes_that_run_exactly(e):
    for q in ("SELECT count(*) AS n FROM lineitem UNION ALL SELECT count(*) FROM orders WITH ERROR 0.1", "SELECT collect_set(l_linestatus) AS n FROM lineitem WITH ERROR 0.1", "SELECT count(IF(l_linenumber > 1, 1, NULL)) AS n FROM lineitem WITH ERROR", "SELECT DISTINCT l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag WITH ERROR 0.1"):
        assert e.sql(q).count() > 0 and e.last_plan_info.sample is None
    with pytest.raises(UnresolvedError):
        e.sql("SELECT sum(l_quantity) AS s, absolute_error(t) FROM lineitem WITH ERROR 0.1")


def test_inserts_and_registry(spark, e, tmp_path):
    e.insert_into("lineitem", spark.table("lineitem").limit(100))
    assert e.sql("SELECT count(*) AS n FROM lineitem WITH ERROR").first().n == 6100 == spark.table("lineitem").count()
    other = AqpSession(spark)
    other.registry.load(e.registry.dump())
    assert other.registry.read_sample("flag").count() == e.registry.read_sample("flag").count() and other.registry.validate() == []
    e.sql("TRUNCATE TABLE flag")
    assert e.sql("SELECT count(*) AS n FROM lineitem WITH ERROR").first().n == 0
    e.sql("DROP TABLE flag")
    with pytest.raises(ValueError):
        e.sql("DROP SAMPLE TABLE flag")
    e.sql("DROP SAMPLE TABLE IF EXISTS flag")


def test_sketches(spark):
    for eps, confidence, depth, width in ((0.01, 0.95, 3, 512), (0.001, 0.99, 5, 4096)):
        assert CmsParams.of(eps, confidence) == CmsParams(depth, width)
    p = CmsParams(4, 64)
    counts = spark.createDataFrame([(i, 1000 // (i + 1)) for i in range(300)], "key long, n long")
    s = sketches.build(counts, p)
    total = sum(1000 // (i + 1) for i in range(300))
    true = {r.key: r.n for r in counts.collect()}
    rows = sketches.estimate(s, counts, p).collect()
    assert all(r.estimate >= true[r.key] for r in rows)
    assert sum(r.estimate > true[r.key] + p.eps * total for r in rows) <= 0.05 * len(rows)
    assert sketches.estimate(s, spark.createDataFrame([(10**9,)], "key long"), p).first().estimate <= p.eps * total * 3
    with pytest.raises(ValueError):
        sketches.merge((s, p), (s, CmsParams(4, 32)))
    with pytest.raises(ValueError):
        sketches.compress(s, CmsParams(4, 200))
    with pytest.raises(Exception, match="negative"):
        sketches.counted(spark.createDataFrame([(1, -1)], "k long, f long"), "k", "f").collect()


def test_topk_options_and_cover():
    for bad in ({}, {"key": "k", "depth": "3", "eps": "0.1"}, {"key": "k", "streamSummary": "true"}, {"key": "k", "maxInterval": "3"}, {"key": "k", "odd": "1"}):
        with pytest.raises(ValueError):
            TopKOptions.parse(bad)
    assert topk.interval_ms("3m") == 180_000 and topk.interval_ms("2000ms") == 2000 and topk.interval_ms("5") == 5
    for a in range(20):
        for b in range(a, 40):
            blocks = topk.cover(a, b, 6)
            assert [s for level, k in blocks for s in range(k << level, (k + 1) << level)] == list(range(a, b + 1))
            assert len(blocks) <= 2 * 6


def test_same_key_adds_up_and_old_rows_are_dropped(spark):
    o = TopKOptions("k", frequency="f", time_column="t", interval_ms=1000, epoch_ms=0)
    rows = spark.createDataFrame([("a", 5, 0), ("a", 10, 900), ("b", 7, 1000), ("c", 1, -1)], "k string, f long, ms long").withColumn("t", F.timestamp_millis("ms"))
    got = {(r.slot, r.key): r.n for r in topk.slots(rows, o, 0).collect()}
    assert got == {(0, "a"): 15, (1, "b"): 7}


def test_failing_table_does_not_stop_the_others(spark, e, sf_dir, tmp_path):
    e.registry.create_topk("hot", {"key": "event_type", "timeSeriesColumn": "ts", "epoch": "0", "timeInterval": "1h"})
    e.registry.create_topk("broken", {"key": "no_such_column"})
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    for _ in range(2):
        with pytest.raises(AnalysisException):
            populate.collect_samples(e, rows, ["broken", "hot"], 1)
    assert e.registry.read_topk("hot").agg(F.sum("n")).first()[0] == 1000
    sampled = e.registry.create_sample("ev", {"qcs": "event_type", "strataReservoirSize": "5"})
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parquet*")
    populate.save_stream(e, stream, [sampled.name], str(tmp_path / "c"), once=True).awaitTermination()
    assert e.registry.read_sample("ev").count() == 25


def test_streams_count_a_replayed_batch_once_and_do_not_swallow_errors(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 3 AS k", "timestamp_millis(id * 1000) AS ts")
    e = AqpSession(spark, str(tmp_path / "kept"))
    e.registry.create_topk("hot", {"key": "k", "timeSeriesColumn": "ts", "timeInterval": "10s", "epoch": "0"})
    e.registry.create_sample("some", {"qcs": "k", "strataReservoirSize": "5"}, rows=rows.limit(0))
    for _ in range(2):
        populate.collect_samples(e, rows, ["hot", "some"], 7)
    again = AqpSession(spark, str(tmp_path / "kept"))  # after a restart
    populate.collect_samples(again, rows, ["hot", "some"], 7)
    assert sum(r.estimated_value for r in again.query_approx_topk("hot").collect()) == 100
    assert again.registry.read_sample("some").count() == 15
    with pytest.raises(ValueError):
        populate.collect_samples(e, rows, ["none", "hot"], 8)
    assert sum(r.estimated_value for r in e.query_approx_topk("hot").collect()) == 200


def test_inserts_reach_tables_of_the_catalog(spark, tmp_path):
    spark.sql(f"CREATE TABLE quern_pt (x INT) USING parquet LOCATION '{tmp_path}/pt'")
    try:
        e = AqpSession(spark)
        e.sql("INSERT INTO quern_pt SELECT 1")
        e.registry.create_sample("pt_sample", {"qcs": "x"}, "quern_pt")
        e.sql("INSERT INTO quern_pt VALUES (2)")
        assert spark.newSession().table("quern_pt").count() == 2
        assert e.registry.read_sample("pt_sample").count() == 2
    finally:
        spark.sql("DROP TABLE quern_pt")
