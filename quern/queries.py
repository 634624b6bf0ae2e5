"""Registered queries of the approximate engine: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import errors, quantiles
from .operators import estimators, sketches, topk
from .operators.estimators import Agg
from .operators.sampling import ROW, TAKEN, TOTAL, SampleOptions, error_estimate_average, error_stats, stratified_sample
from .operators.sketches import CmsParams
from .operators.topk import TopKOptions
from .plans import selection
from .session import AqpSession
from .streaming import populate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FLAG = SampleOptions(("l_returnflag",), reservoir=50)
SUPPLIER = SampleOptions(("l_suppkey",), reservoir=20)
#: Places to which estimates are rounded, so that the order of additions does not show.
PLACES = 4
TRIALS = 20


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *samples: str, tables=("lineitem",), **conf) -> AqpSession:
    """An engine over the tables; samples: `flag` and `supp` of lineitem by return flag and supplier."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    made = AqpSession(spark, **conf)
    for s in samples:
        made.registry.create_sample(s, {"flag": FLAG, "supp": SUPPLIER}[s], "lineitem")
    return made


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), PLACES).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def shown(df: DataFrame, aliases: list[str]) -> DataFrame:
    """Estimates and their errors, rounded."""
    return rounded(df.withColumnsRenamed({errors.column(f, a): f"{a}_{f}" for a in aliases for f in errors.FUNCTIONS}))


def strata(sample: DataFrame, *by: str) -> DataFrame:
    """Rows, population and weight of each group of a sample."""
    return sample.groupBy(*by).agg(F.count("*").alias("n_rows"), F.round(F.sum(F.col(TOTAL) / F.col(TAKEN)), PLACES).alias("weight"), F.sum("l_orderkey").alias("key_sum"))


# Samplers


@query
def sample_reservoir(spark, sf_dir):
    return strata(stratified_sample(table(spark, sf_dir, "lineitem"), FLAG), "l_returnflag")


@query
def sample_fraction(spark, sf_dir):
    return strata(stratified_sample(table(spark, sf_dir, "lineitem"), SampleOptions(("l_suppkey",), fraction=0.05, reservoir=5)), "l_suppkey")


@query
def sample_error_limit(spark, sf_dir):
    options = SampleOptions(("l_returnflag",), reservoir=10, error_column="l_quantity", error_percent=5.0)
    return strata(stratified_sample(table(spark, sf_dir, "lineitem"), options), "l_returnflag")


@query
def sample_time_slot(spark, sf_dir):
    sample = stratified_sample(table(spark, sf_dir, "events"), SampleOptions(("event_type",), reservoir=5, time_column="ts", time_interval="1 day"))
    return sample.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_rows"), F.max(TOTAL).alias("total"), F.sum("event_id").alias("key_sum"))


@query
def sample_qcs_expression(spark, sf_dir):
    sample = stratified_sample(table(spark, sf_dir, "lineitem"), SampleOptions(("year(l_shipdate)", "l_linestatus"), reservoir=15))
    return strata(sample.withColumn("y", F.year("l_shipdate")), "y", "l_linestatus")


@query
def sample_dataframe(spark, sf_dir):
    made = AqpSession(spark).stratified_sample(table(spark, sf_dir, "lineitem"), {"qcs": "l_linestatus", "strataReservoirSize": "40"})
    return strata(made, "l_linestatus")


@query
def sample_copies(spark, sf_dir):
    """A table of a few distinct rows with many copies each."""
    made = stratified_sample(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), FLAG)
    return made.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n_rows"), F.max(TOTAL).alias("total"))


@query
def register_sample(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.stratified_sample(spark.table("lineitem"), FLAG, register_as="flag", base="lineitem")
    return e.sql("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag WITH ERROR")


@query
def sample_lookup(spark, sf_dir):
    e = engine(spark, sf_dir, "flag", "supp")
    return spark.createDataFrame([(s.name, ",".join(s.options.qcs), s.options.reservoir) for s in e.registry.samples_of("lineitem")], "name string, qcs string, reservoir long")


@query
def error_stats_by_group(spark, sf_dir):
    return rounded(error_stats(stratified_sample(table(spark, sf_dir, "lineitem"), SUPPLIER), "l_quantity", ["l_suppkey"]))


@query
def error_estimate_of_average(spark, sf_dir):
    return rounded(error_estimate_average(stratified_sample(table(spark, sf_dir, "lineitem"), SUPPLIER), "l_quantity", ["l_suppkey"]))


@query
def student_t_cache(spark, sf_dir):
    return spark.createDataFrame([(d, round(quantiles.t(0.975, d), 6)) for d in range(1, 29)] + [(30, round(quantiles.z(0.975), 6))], "df long, q double")


# Tables and statements


@query
def create_sample_table(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sql("CREATE SAMPLE TABLE IF NOT EXISTS flag ON lineitem OPTIONS (qcs 'l_returnflag', strataReservoirSize '50')")
    return strata(e.registry.read_sample("flag"), "l_returnflag")


@query
def create_using_column_sample(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE flag USING column_sample OPTIONS (qcs 'l_returnflag', strataReservoirSize '50', baseTable 'lineitem')")
    return strata(e.registry.read_sample("flag"), "l_returnflag")


@query
def populate_on_create(spark, sf_dir):
    return engine(spark, sf_dir, "supp").sql("SELECT count(*) AS n FROM supp")


@query
def insert_into_sample(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    e.insert_into("flag", spark.table("lineitem").filter("l_quantity > 25"))
    return e.registry.read_sample("flag").groupBy("l_returnflag", F.col("quern_batch").alias("batch")).agg(F.count("*").alias("n_rows"), F.max(TOTAL).alias("total"))


@query
def bypass_insert(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    e.registry.create_sample("copy", SampleOptions(("l_returnflag",), bypass=True), rows=e.registry.read_sample("flag"))
    return strata(e.registry.read_sample("copy"), "l_returnflag")


@query
def base_insert_propagates(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    e.insert_into("lineitem", spark.table("lineitem").filter("l_quantity > 25"))
    return e.sql("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag WITH ERROR")


@query
def truncate_sample(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    e.sql("TRUNCATE TABLE flag")
    return e.registry.read_sample("flag").agg(F.count("*").alias("n"))


@query
def drop_sample(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    e.sql("DROP SAMPLE TABLE flag")
    return e.sql("SELECT l_returnflag, sum(l_linenumber) AS s, absolute_error(s) AS e FROM lineitem GROUP BY l_returnflag WITH ERROR 0.1")


@query
def scan_sample(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_orderkey, l_linenumber FROM flag WHERE l_quantity > 25")


# Projections and filters


@query
def sample_projection(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, l_orderkey, l_partkey FROM flag")


@query
def no_aggregate_exact(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 WITH ERROR 0.1")


@query
def weight_propagation(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    return rounded(e.sql("SELECT f, sum(q2) AS s FROM (SELECT l_returnflag AS f, l_quantity * 2 AS q2 FROM lineitem WHERE l_linenumber < 5) t GROUP BY f WITH ERROR"))


@query
def filter_pre_agg(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    return rounded(e.sql("SELECT l_returnflag, sum(l_quantity) AS s, absolute_error(s) AS e FROM lineitem WHERE l_linenumber < 4 GROUP BY l_returnflag WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def having_agg(spark, sf_dir):
    e = engine(spark, sf_dir, "supp")
    return rounded(e.sql("SELECT l_suppkey, sum(l_quantity) AS s, relative_error(s) AS r FROM lineitem GROUP BY l_suppkey HAVING relative_error(s) > 0.1 AND sum(l_quantity) > 10 WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def alias_in_error_fn(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, avg(l_quantity) AS a, lower_bound(a) AS lo, upper_bound(a) AS hi FROM lineitem GROUP BY l_returnflag WITH ERROR 0.5 BEHAVIOR 'do_nothing'"))


@query
def error_fn_naming(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT sum(l_quantity) AS s, absolute_error(s), relative_error(s) FROM lineitem WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def case_null_agg(spark, sf_dir):
    sql = "SELECT l_returnflag, sum(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END) AS s, count(CASE WHEN l_linenumber > 2 THEN 1 END) AS n, absolute_error(n) AS e FROM lineitem GROUP BY l_returnflag WITH ERROR 0.9 BEHAVIOR 'do_nothing'"
    return rounded(engine(spark, sf_dir, "flag").sql(sql))


# Joins


@query
def join_inner_sample_dim(spark, sf_dir):
    e = engine(spark, sf_dir, "flag", tables=("lineitem", "supplier"))
    e.registry.replicated.add("supplier")
    return rounded(e.sql("SELECT s.s_nationkey, sum(l.l_quantity) AS q, absolute_error(q) AS e FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_nationkey WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def join_left_outer(spark, sf_dir):
    e = engine(spark, sf_dir, "flag", tables=("lineitem", "supplier"))
    return rounded(e.sql("SELECT l.l_returnflag, sum(l.l_quantity) AS q, count(s.s_suppkey) AS n FROM lineitem l LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l.l_suppkey = s.s_suppkey GROUP BY l.l_returnflag WITH ERROR"))


@query
def join_right_outer(spark, sf_dir):
    e = engine(spark, sf_dir, "flag", tables=("lineitem", "supplier"))
    return rounded(e.sql("SELECT l.l_returnflag, sum(l.l_quantity) AS q FROM supplier s RIGHT OUTER JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY l.l_returnflag WITH ERROR"))


@query
def join_full_outer(spark, sf_dir):
    e = engine(spark, sf_dir, "flag", tables=("lineitem", "supplier"))
    return e.sql("SELECT l.l_returnflag, count(*) AS n FROM lineitem l FULL OUTER JOIN supplier s ON l.l_suppkey = s.s_suppkey AND l.l_quantity > 25 GROUP BY l.l_returnflag WITH ERROR")


@query
def join_left_semi(spark, sf_dir):
    e = engine(spark, sf_dir, "flag", tables=("lineitem", "supplier"))
    return e.sql("SELECT l_returnflag, count(*) AS n FROM lineitem l LEFT SEMI JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0 GROUP BY l_returnflag WITH ERROR")


@query
def join_left_anti(spark, sf_dir):
    e = engine(spark, sf_dir, "flag", tables=("lineitem", "supplier"))
    return e.sql("SELECT l_returnflag, count(*) AS n FROM lineitem l LEFT ANTI JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0 GROUP BY l_returnflag WITH ERROR")


@query
def join_subqueries(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    return e.sql("SELECT a.f, a.n, b.s FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY l_returnflag) a JOIN (SELECT l_returnflag AS f, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag) b ON a.f = b.f WITH ERROR")


@query
def join_analysis_choice(spark, sf_dir):
    cases = [(k, j, i, d) for k in ("sum", "count", "avg") for j in (False, True) for i in (False, True) for d in (False, True)]
    made = [(*c, selection.choose_analysis({c[0]}, joins=c[1], inner_only=c[2], other_distributed=c[3], error_functions=True)) for c in cases]
    return spark.createDataFrame(made, "kind string, joins boolean, inner_only boolean, other_distributed boolean, analysis string")


# Aggregates


def _weighted(kind):
    def run(spark, sf_dir):
        e = engine(spark, sf_dir, "supp")
        return rounded(e.sql(f"SELECT l_returnflag, {kind}(l_quantity) AS v FROM lineitem WHERE l_linenumber > 2 GROUP BY l_returnflag WITH ERROR"))

    return run


def _estimated(kind, how):
    def run(spark, sf_dir):
        sample = stratified_sample(table(spark, sf_dir, "lineitem"), SUPPLIER)
        aggs, by = [Agg(kind, "l_quantity", "v")], {"l_returnflag": F.col("l_returnflag")}
        rows = sample.filter("l_linenumber > 2")
        made = estimators.closed_form(rows, by, aggs) if how == "closedform" else estimators.bootstrap(rows, by, aggs, F.col(ROW), 0.9, TRIALS)
        return shown(made, ["v"])

    return run


for _kind in ("sum", "count", "avg"):
    QUERIES[f"agg_{_kind}_weighted"] = _weighted(_kind)
    QUERIES[f"agg_{_kind}_closedform"] = _estimated(_kind, "closedform")
    QUERIES[f"agg_{_kind}_bootstrap"] = _estimated(_kind, "bootstrap")


@query
def agg_bootstrap_multiplicity(spark, sf_dir):
    rows = stratified_sample(table(spark, sf_dir, "lineitem"), FLAG).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(TRIALS - 1))))
    mult = F.when(F.col("trial") == 0, 1).otherwise(estimators.poisson(estimators.trial_uniform(F.col(ROW), F.col("trial"))))
    return rows.groupBy("l_linestatus", "trial").agg(F.sum(mult).cast("long").alias("rows"), (F.sum(mult) > 0).alias("there"))


@query
def agg_min_max_qcs(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "supp").sql("SELECT min(l_suppkey) AS a, max(l_suppkey) AS b, sum(l_quantity) AS s FROM lineitem WITH ERROR"))


@query
def agg_only_min_max(spark, sf_dir):
    return engine(spark, sf_dir, "supp").sql("SELECT min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem WITH ERROR 0.1")


@query
def agg_count_distinct(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, count(DISTINCT l_partkey) AS n, absolute_error(n) AS e, lower_bound(n) AS lo FROM lineitem GROUP BY l_returnflag WITH ERROR 0.1")


@query
def agg_unsupported(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, stddev_samp(l_quantity) AS d, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag WITH ERROR 0.1"))


@query
def join_two_samples(spark, sf_dir):
    """Both tables have a sample; the first one's stands in, the other table is read as it is."""
    e = engine(spark, sf_dir, "flag", tables=("lineitem", "orders"))
    e.registry.create_sample("by_status", SampleOptions(("o_orderstatus",), reservoir=20), "orders")
    return rounded(e.sql("SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def agg_filter_clause(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linenumber < 4) AS s, absolute_error(s) AS e, count(*) FILTER (WHERE l_linenumber < 3) AS n FROM lineitem GROUP BY l_returnflag WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def alias_with_spaces(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, sum(l_quantity) AS `the sum`, absolute_error(`the sum`) AS `its error` FROM lineitem GROUP BY l_returnflag HAVING `the sum` > 0 ORDER BY `the sum` WITH ERROR 0.9 BEHAVIOR 'do_nothing'").toDF("l_returnflag", "s", "e"))


@query
def agg_group_by(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_returnflag AS f, l_linenumber % 2 AS odd, count(*) AS n FROM lineitem GROUP BY 1, odd WITH ERROR")


@query
def agg_arith_over_agg(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, abs(-sum(l_quantity)) / count(*) + 1 AS v, CAST(sqrt(sum(l_quantity)) AS DOUBLE) AS w FROM lineitem GROUP BY l_returnflag WITH ERROR"))


@query
def agg_expr_of_errors(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, sum(l_quantity) AS s, upper_bound(s) - lower_bound(s) AS w FROM lineitem GROUP BY l_returnflag HAVING absolute_error(s) > 0 ORDER BY relative_error(s) DESC WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def agg_repeat(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, sum(l_quantity) AS a, sum( l_quantity ) AS b, sum(l_quantity) * 2 AS c, absolute_error(a) AS e, absolute_error(b) AS f FROM lineitem GROUP BY l_returnflag WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def agg_nested(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "supp").sql("SELECT max(n) AS most, avg(n) AS mean FROM (SELECT l_suppkey, sum(l_linenumber) AS n FROM lineitem GROUP BY l_suppkey) t WITH ERROR"))


@query
def sample_prefix_skip(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, count(*) AS sample_n, count(*) AS n FROM lineitem GROUP BY l_returnflag WITH ERROR")


@query
def sample_direct_query(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_linestatus, sum(l_linenumber) AS s FROM flag GROUP BY l_linestatus")


@query
def agg_rollup(spark, sf_dir):
    return engine(spark, sf_dir, "flag").sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus) WITH ERROR 0.1")


@query
def view_sample(spark, sf_dir):
    e = engine(spark, sf_dir, "flag")
    e.create_view("v", "SELECT l_returnflag AS f, IF(l_quantity > 25, l_quantity, 0) AS q FROM lineitem")
    return rounded(e.sql("SELECT f, sum(q) AS s, absolute_error(s) AS e FROM v GROUP BY f WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


# Error functions


def _error_function(name):
    def run(spark, sf_dir):
        return rounded(engine(spark, sf_dir, "flag").sql(f"SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS s, {name}(n) AS of_n, {name}(s) AS of_s FROM lineitem GROUP BY l_returnflag WITH ERROR 0.9 CONFIDENCE 0.9 BEHAVIOR 'do_nothing'"))

    return run


for _name in errors.FUNCTIONS:
    QUERIES[_name] = _error_function(_name)


# The accuracy contract

HAC = "SELECT l_suppkey, sum(l_quantity) AS s, relative_error(s) AS r, lower_bound(s) AS lo FROM lineitem GROUP BY l_suppkey"
HAC_ERROR = 0.25


def _behavior(name, sql=HAC, tail="", limit=HAC_ERROR):
    def run(spark, sf_dir):
        return rounded(engine(spark, sf_dir, "supp").sql(f"{sql}{tail} WITH ERROR {limit} BEHAVIOR '{name}'"))

    return run


QUERIES |= {
    "hac_do_nothing": _behavior("do_nothing"),
    "hac_local_omit": _behavior("local_omit"),
    "hac_strict": _behavior("strict", limit=0.99),
    "hac_run_on_full_table": _behavior("run_on_full_table"),
    "hac_partial_run": _behavior("partial_run_on_base_table"),
    "hac_partial_no_groupby": _behavior("partial_run_on_base_table", "SELECT sum(l_quantity) AS s, relative_error(s) AS r FROM lineitem", limit=0.0001),
    "hac_partial_having": _behavior("partial_run_on_base_table", tail=" HAVING sum(l_quantity) > 500 ORDER BY l_suppkey"),
    "hac_inner_limit": _behavior("strict", tail=" ORDER BY relative_error(s), l_suppkey LIMIT 3"),
}


@query
def hac_direct_sample_route(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "supp").sql("SELECT sum(l_quantity) AS s, absolute_error(s) AS e FROM supp WITH ERROR 0.5 BEHAVIOR 'run_on_full_table'"))


@query
def with_error_api(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem")
    e = AqpSession(spark)
    sample = e.stratified_sample(base, SUPPLIER)
    return shown(e.with_error(sample, ["l_suppkey"], [("sum", "l_quantity", "s")], HAC_ERROR, 0.95, "PARTIAL_RUN_ON_BASE_TABLE", base), ["s"])


@query
def sort_by_estimate(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "supp").sql("SELECT l_suppkey, sum(l_quantity) AS s FROM lineitem GROUP BY l_suppkey ORDER BY s DESC, l_suppkey LIMIT 10 WITH ERROR"))


@query
def sort_by_error_fn(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "supp").sql("SELECT l_suppkey, sum(l_quantity) AS s, absolute_error(s) AS e FROM lineitem GROUP BY l_suppkey ORDER BY e DESC, l_suppkey LIMIT 10 WITH ERROR 0.9 BEHAVIOR 'do_nothing'"))


@query
def limit_topn(spark, sf_dir):
    return rounded(engine(spark, sf_dir, "supp").sql("SELECT l_suppkey, avg(l_quantity) AS a FROM lineitem GROUP BY l_suppkey ORDER BY avg(l_quantity), l_suppkey LIMIT 7 WITH ERROR"))


@query
def select_sample(spark, sf_dir):
    c = [selection.Candidate(n, frozenset(q.split()), f) for n, q, f in (("s1", "carrier month year", 0.03), ("s2", "carrier month", 0.01), ("s3", "carrier month year", 0.05), ("s4", "tan(arrtime)", 0.05))]
    asks = [("carrier", "month"), ("carrier", ""), ("carrier", "month year arrdelay"), ("arrtime", "month year arrdelay"), ("tan(arrtime)", "month year arrdelay")]
    return spark.createDataFrame([(g, w, selection.select_sample(c, set(g.split()), set(w.split())).name) for g, w in asks], "grouping string, filtering string, sample string")


# Top-K and sketches

DAY = 86_400_000
EPOCH = 1_704_067_200_000  # 2024-01-01
EVENTS = TopKOptions("user_id", time_column="ts", interval_ms=DAY, epoch_ms=EPOCH)
CMS = CmsParams.of(0.02, 0.95)


def events_topk(spark, sf_dir, **options):
    e = engine(spark, sf_dir, tables=("events",))
    e.registry.create_topk("hot", {"key": "user_id", "timeSeriesColumn": "ts", "timeInterval": f"{DAY}ms", "epoch": str(EPOCH)} | options, "events")
    return e


def answer(df):
    return df.select(F.col("key").cast("long").alias("key"), "estimated_value")


@query
def topk_batch(spark, sf_dir):
    return answer(events_topk(spark, sf_dir).query_approx_topk("hot", 10))


@query
def topk_frequency_col(spark, sf_dir):
    return answer(events_topk(spark, sf_dir, frequencyCol="value").query_approx_topk("hot", 10))


@query
def topk_time_range(spark, sf_dir):
    return answer(events_topk(spark, sf_dir).query_approx_topk("hot", 10, "2024-01-03 00:00:00", "2024-01-09 12:00:00"))


@query
def topk_between(spark, sf_dir):
    return answer(events_topk(spark, sf_dir).query_approx_topk("hot", 5, EPOCH + 5 * DAY, None))


@query
def topk_current(spark, sf_dir):
    e = engine(spark, sf_dir, tables=("events",))
    e.registry.create_topk("hot", {"key": "event_type"}, "events")
    return e.query_approx_topk("hot", 3).select("key", "estimated_value")


@query
def create_topk_table(spark, sf_dir):
    e = engine(spark, sf_dir, tables=("events",))
    e.sql(f"CREATE TOPK TABLE hot ON events OPTIONS (key 'event_type', timeSeriesColumn 'ts', timeInterval '1h', epoch '{EPOCH}', size '5')")
    return e.registry.read_topk("hot").groupBy("key").agg(F.count("*").alias("slots"), F.sum("n").alias("n"))


@query
def topk_sql(spark, sf_dir):
    return events_topk(spark, sf_dir).sql("SELECT user_id, sum(EstimatedValue) AS n, min(StartTime) AS first FROM hot WHERE StartTime >= '2024-01-02 00:00:00' GROUP BY user_id")


@query
def scan_topk(spark, sf_dir):
    return events_topk(spark, sf_dir).sql("SELECT user_id, EstimatedValue AS n FROM hot WHERE StartTime = '2024-01-03 00:00:00' AND EndTime = '2024-01-04 00:00:00'")


@query
def insert_topk(spark, sf_dir):
    e = events_topk(spark, sf_dir)
    e.insert_into("hot", spark.table("events"))
    return answer(e.query_approx_topk("hot", 5))


@query
def truncate_topk(spark, sf_dir):
    e = events_topk(spark, sf_dir)
    e.sql("TRUNCATE TABLE hot")
    e.insert_into("hot", spark.table("events").filter("event_type = 'click'"))
    return answer(e.query_approx_topk("hot", 5))


@query
def drop_topk(spark, sf_dir):
    e = events_topk(spark, sf_dir)
    e.sql("DROP TOPK TABLE hot")
    return spark.createDataFrame([(len(e.registry.topks),)], "tables long")


def _user_counts(spark, sf_dir):
    return sketches.counted(table(spark, sf_dir, "events"), "user_id")


@query
def cms_add(spark, sf_dir):
    return sketches.build(_user_counts(spark, sf_dir), CMS).select("row", "col", "n")


@query
def cms_estimate(spark, sf_dir):
    counts = _user_counts(spark, sf_dir)
    return sketches.estimate(sketches.build(counts, CMS), counts, CMS)


@query
def cms_params(spark, sf_dir):
    made = [(e, c, CmsParams.of(e, c)) for e in (0.001, 0.01, 0.05) for c in (0.9, 0.95, 0.99)]
    return spark.createDataFrame([(e, c, p.depth, p.width) for e, c, p in made], "eps double, confidence double, depth long, width long")


@query
def cms_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    a, b = (sketches.build(sketches.counted(rows.filter(f"{n}(event_type = 'click')"), "user_id"), CMS) for n in ("", "NOT "))
    return sketches.merge((a, CMS), (b, CMS)).select("row", "col", "n")


@query
def cms_compress(spark, sf_dir):
    return sketches.compress(sketches.build(_user_counts(spark, sf_dir), CMS), CMS)[0].select("row", "col", "n")


@query
def cms_bounds(spark, sf_dir):
    counts = _user_counts(spark, sf_dir)
    total = counts.agg(F.sum("n").alias("total"))
    made = sketches.estimate(sketches.build(counts, CMS), counts, CMS).join(F.broadcast(total)).withColumn("a", sketches.approximate(F.col("estimate"), F.col("total"), CMS))  # total is one row
    return made.select("key", "a.lower_bound", "a.estimate", "a.max")


@query
def approximate_arith(spark, sf_dir):
    n = _user_counts(spark, sf_dir)
    a, b = sketches.approximate(F.col("n"), F.col("n") * 10, CMS), sketches.approximate(F.col("n") * 2, F.col("n") * 10, CMS)
    return n.select("key", sketches.add(a, b).alias("s"), sketches.subtract(b, a).alias("d")).select("key", F.col("s.lower_bound").alias("add_low"), F.col("s.max").alias("add_max"), F.col("d.lower_bound").alias("sub_low"), F.col("d.max").alias("sub_max"))


def _slots(spark, sf_dir):
    return topk.slots(table(spark, sf_dir, "events"), EVENTS, EPOCH)


@query
def topk_cms(spark, sf_dir):
    counts = _slots(spark, sf_dir)
    return topk.sketched_top(counts, topk.sketched(counts, CMS), 10, CMS).withColumnRenamed("n", "estimated_value")


@query
def topk_cms_merge(spark, sf_dir):
    counts = _slots(spark, sf_dir)
    parts = [sketches.estimate(sketches.build(c, CMS), c, CMS) for c in (counts.filter("slot < 10").groupBy("key").agg(F.sum("n").alias("n")), counts.filter("slot >= 10").groupBy("key").agg(F.sum("n").alias("n")))]
    return topk.ranked(parts[0].unionByName(parts[1]).groupBy("key").agg(F.sum("estimate").alias("n")), 10).withColumnRenamed("n", "estimated_value")


LEVELS = 6


@query
def hokusai_time_agg(spark, sf_dir):
    return topk.dyadic(_slots(spark, sf_dir), LEVELS).groupBy("level", "block").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n"))


DECAYING = CmsParams(3, 4096)


def _decaying(spark, sf_dir):
    """A top-K table of decaying sketches, filled by a late and an early insert."""
    e = engine(spark, sf_dir, tables=("events",))
    e.sql(f"CREATE TABLE hot USING topk OPTIONS (key 'user_id', timeSeriesColumn 'ts', timeInterval '1h', epoch '{EPOCH}', depth '{DECAYING.depth}', width '{DECAYING.width}')")
    for part in ("NOT event_type <=> 'click'", "event_type = 'click'"):
        e.insert_into("hot", spark.table("events").filter(part))
    return e


def _users(spark):
    return spark.table("events").select(F.col("user_id").alias("key"))


@query
def hokusai_item_agg(spark, sf_dir):
    e = _decaying(spark, sf_dir)
    cells = e.registry.sketch_topk("hot").filter("level = 0")
    return cells.groupBy(F.col("block").alias("slot")).agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum(F.col("col") * F.col("n")).alias("col_sum"))


@query
def hokusai_blocks(spark, sf_dir):
    e = _decaying(spark, sf_dir)
    return e.registry.sketch_topk("hot").filter("level > 0").groupBy("level", "block").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


@query
def hokusai_point(spark, sf_dir):
    e = _decaying(spark, sf_dir)
    return e.registry.estimate_topk("hot", _users(spark), 100, 100)


@query
def topk_sketched(spark, sf_dir):
    e = engine(spark, sf_dir, tables=("events",))
    e.sql(f"CREATE TOPK TABLE hot ON events OPTIONS (key 'user_id', timeSeriesColumn 'ts', timeInterval '{DAY}ms', epoch '{EPOCH}', depth '5', width '64')")
    top = e.query_approx_topk("hot", 10, EPOCH + 2 * DAY, EPOCH + 8 * DAY)
    return top.select("key", "estimated_value", "error_bounds.lower_bound", "error_bounds.max")


@query
def topk_stream_summary(spark, sf_dir):
    e = engine(spark, sf_dir, tables=("events",))
    e.sql(f"CREATE TABLE hot USING topk OPTIONS (key 'user_id', timeSeriesColumn 'ts', timeInterval '{DAY}ms', epoch '{EPOCH}', streamSummary 'true', maxInterval '7', size '20')")
    for part in ("event_type = 'click'", "NOT event_type = 'click'"):
        e.insert_into("hot", spark.table("events").filter(part))
    return e.sql("SELECT user_id, EstimatedValue AS n, DeltaError AS delta, StartTime AS start FROM hot")


@query
def hokusai_till(spark, sf_dir):
    counts = _slots(spark, sf_dir)
    last = counts.agg(F.max("slot")).first()[0] or 0
    return topk.between(topk.dyadic(counts, LEVELS), max(last - 6, 0), last, LEVELS)


@query
def hokusai_between(spark, sf_dir):
    return topk.between(topk.dyadic(_slots(spark, sf_dir), LEVELS), 3, 17, LEVELS)


@query
def hokusai_interpolate(spark, sf_dir):
    """Slots that fill no block of the oldest half, so that they are shared out of it."""
    e = _decaying(spark, sf_dir)
    return e.registry.estimate_topk("hot", _users(spark), 3, 50)


@query
def hokusai_late_data(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    late = F.hour("ts") < 6
    fresh = topk.slots(rows.filter(~late), EVENTS, EPOCH)
    return topk.merged(fresh, topk.slots(rows.filter(late), EVENTS, EPOCH)).groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("n_keys"))


@query
def interval_tracker(spark, sf_dir):
    made = [(a, b, " ".join(f"{v}:{k}" for v, k in topk.cover(a, b, LEVELS))) for a in range(8) for b in range(a, 16)]
    return spark.createDataFrame(made, "first long, last long, blocks string")


@query
def stream_summary(spark, sf_dir):
    return topk.stream_summary(table(spark, sf_dir, "events"), TopKOptions("user_id", time_column="ts", interval_ms=DAY, size=3, max_interval=20, stream_summary=True), EPOCH)


# Streams


def _stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def _fed(spark, sf_dir, make, formatter=None):
    e = engine(spark, sf_dir, tables=("events",))
    make(e)
    q = populate.save_stream(e, _stream(spark, sf_dir), [*e.registry.samples, *e.registry.topks], f"{e.registry.root}/checkpoint", formatter, once=True)
    q.awaitTermination()
    return e


@query
def stream_populate(spark, sf_dir):
    return answer(_fed(spark, sf_dir, lambda e: e.registry.create_topk("hot", {"key": "user_id", "timeSeriesColumn": "ts", "timeInterval": f"{DAY}ms", "epoch": str(EPOCH)})).query_approx_topk("hot", 10))


@query
def save_stream(spark, sf_dir):
    e = _fed(spark, sf_dir, lambda e: e.registry.create_topk("hot", {"key": "kind", "timeSeriesColumn": "ts", "timeInterval": f"{DAY}ms", "epoch": str(EPOCH)}), lambda b: b.withColumn("kind", F.upper("event_type")))
    return e.query_approx_topk("hot", 10).select("key", "estimated_value")


@query
def stream_event_time(spark, sf_dir):
    e = _fed(spark, sf_dir, lambda e: e.registry.create_topk("hot", {"key": "event_type", "timeSeriesColumn": "ts", "timeInterval": "6h", "epoch": str(EPOCH)}))
    return e.registry.read_topk("hot")


@query
def stream_late_data(spark, sf_dir):
    e = _fed(spark, sf_dir, lambda e: e.registry.create_topk("hot", {"key": "event_type", "timeSeriesColumn": "ts", "timeInterval": f"{DAY}ms", "epoch": str(EPOCH)}))
    populate.collect_samples(e, spark.table("events").filter("ts < '2024-01-05'"), ["hot"], batch_id=1_000)
    return e.registry.read_topk("hot").groupBy("slot").agg(F.sum("n").alias("n"))


@query
def stream_epoch(spark, sf_dir):
    e = _fed(spark, sf_dir, lambda e: e.registry.create_topk("hot", {"key": "event_type", "timeSeriesColumn": "ts", "timeInterval": "12h"}))
    return e.registry.read_topk("hot")


@query
def stream_window_cq(spark, sf_dir):
    made = populate.windowed(_stream(spark, sf_dir), "ts", "2 days", "1 day", by=["event_type"], n="count(*)")
    name = "quern_cq"
    q = made.select(F.col("window.start").alias("start"), "event_type", "n").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query
def scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_orderkey", "l_quantity")


@query
def window_over_aggregate(spark, sf_dir):
    w = Window.partitionBy("l_returnflag")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_orderkey").alias("s"))
    return rounded(sums.withColumn("mean", F.avg("s").over(w)))


