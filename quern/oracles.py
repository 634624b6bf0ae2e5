"""DuckDB SQL with the rows of the registered queries, written from the definitions."""

from __future__ import annotations

from .functions.errors import FUNCTIONS
from .functions.quantiles import factor_sql, t, z
from .operators.estimators import POISSON
from .operators.sketches import CmsParams
from .operators.topk import cover
from .queries import CMS, DAY, EPOCH, HAC_ERROR, LEVELS, TRIALS

ORACLES: dict[str, str] = {}

LINEITEM = (
    "md5('quern|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || CAST(round(l_quantity * 100) AS BIGINT) || '|' || CAST(round(l_extendedprice * 100) AS BIGINT)"
    " || '|' || CAST(round(l_discount * 100) AS BIGINT) || '|' || CAST(round(l_tax * 100) AS BIGINT) || '|' || l_returnflag || '|' || l_linestatus || '|' || epoch_us(l_shipdate))"
)
EVENT = "md5('quern|' || event_id || '|' || epoch_us(ts) || '|' || user_id || '|' || event_type || '|' || CAST(round(value * 100) AS BIGINT) || '|' || coalesce(props, ''))"


def sample(name: str, qcs: str, k: str, base: str = "lineitem", hash_: str = LINEITEM) -> str:
    """CTEs that end in `name`: the base's columns with h, stratum, taken, total and rn."""
    return f"""{name}_h AS (SELECT *, {hash_} AS h, concat_ws('|', {qcs}) AS stratum FROM {base}),
{name}_c AS (SELECT stratum, count(*) AS total FROM {name}_h GROUP BY stratum),
{name} AS (SELECT *, least({k}, total) AS taken FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS rn FROM {name}_h) JOIN {name}_c USING (stratum) WHERE rn <= {k})"""


FLAG = sample("flag", "l_returnflag", "50")
SUPP = sample("supp", "l_suppkey", "20")
W = "(total / taken)"


def strata(ctes: str, name: str, *by: str) -> str:
    g = ", ".join(by)
    return f"WITH {ctes} SELECT {g}, count(*) AS n_rows, round(sum(total / taken), 4) AS weight, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM {name} GROUP BY {', '.join(str(i + 1) for i in range(len(by)))}"


def closed(ctes: str, rows: str, by: list[str], aggs: dict[str, tuple[str, str]], confidence: float = 0.95) -> str:
    """CTEs that end in `est`: by, and for each alias (kind, value) the estimate and its errors,
    as alias and alias_absolute_error and so on; rows: FROM and WHERE over a sample."""
    names = [b.rpartition(" AS ")[2] for b in by]
    first, second, third = [], [], []
    for i, (a, (kind, v)) in enumerate(aggs.items()):
        x = f"CAST({v} AS DOUBLE)" if kind != "count" else f"CASE WHEN {v} IS NOT NULL THEN 1.0::DOUBLE END"
        first += [f"count({x}) AS c{i}", f"sum({x}) AS s{i}", f"sum({x} * {x}) AS q{i}"]
        m = "(CASE WHEN taken > 1 THEN total * (total - taken) / (taken - 1) ELSE 0 END)"
        v_ = f"{m} * (c{i} / taken) * (1 - c{i} / taken)" if kind == "count" else f"{m} * (q{i} / taken - (s{i} / taken) * (s{i} / taken))"
        second += [f"sum(c{i} * {W}) AS w{i}", f"sum(s{i} * {W}) AS x{i}", f"sum(greatest(coalesce({v_}, 0), 0)) AS v{i}", f"sum(c{i}) AS k{i}"]
        e = {"count": f"coalesce(w{i}, 0)", "sum": f"CASE WHEN k{i} > 0 THEN x{i} END", "avg": f"CASE WHEN k{i} > 0 THEN x{i} / w{i} END"}[kind]
        d = f"sqrt(v{i} / (w{i} * w{i}))" if kind == "avg" else f"sqrt(v{i})"
        third += [f"{e} AS {a}", f"CASE WHEN k{i} > 0 THEN {d} * {factor_sql(f'k{i}', confidence)} END AS b{i}"]
    last = []
    for i, a in enumerate(aggs):
        last += [a, f"abs(b{i}) AS {a}_absolute_error", f"CASE WHEN abs({a}) > 1 THEN abs(b{i} / {a}) ELSE abs(b{i}) / (abs({a}) + 1) END AS {a}_relative_error", f"{a} - b{i} AS {a}_lower_bound", f"{a} + b{i} AS {a}_upper_bound"]
    g, n = ", ".join(by + [""]), ", ".join(names + [""])
    group = f"GROUP BY {', '.join(names)}" if names else ""
    return f"""{ctes},
est1 AS (SELECT {g}stratum, taken, total, {', '.join(first)} FROM {rows} GROUP BY {', '.join([*(str(i + 1) for i in range(len(by))), 'stratum', 'taken', 'total'])}),
est2 AS (SELECT {n}{', '.join(second)} FROM est1 {group}),
est3 AS (SELECT {n}{', '.join(third)} FROM est2),
est AS (SELECT {n}{', '.join(last)} FROM est3)"""


def pick(ctes: str, columns: str, tail: str = "") -> str:
    return f"WITH {ctes} SELECT {columns} FROM est {tail}"


def shown(aliases: list[str], *by: str) -> str:
    return ", ".join([*by, *[f"round({c}, 4) AS {c}" for a in aliases for c in (a, *[f"{a}_{f}" for f in FUNCTIONS])]])


ORACLES["sample_reservoir"] = ORACLES["create_sample_table"] = ORACLES["create_using_column_sample"] = ORACLES["bypass_insert"] = strata(FLAG, "flag", "l_returnflag")
ORACLES["sample_fraction"] = strata(
    "n AS (SELECT l_suppkey, count(*) AS total FROM lineitem GROUP BY l_suppkey), goal AS (SELECT CAST(round(0.05 * sum(total)) AS BIGINT) AS goal FROM n),"
    " k AS (SELECT coalesce(max(k), 5) AS k FROM (SELECT unnest(range(5, (SELECT max(total) + 1 FROM n))) AS k) r WHERE (SELECT sum(least(total, r.k)) FROM n) <= (SELECT goal FROM goal)),"
    + sample("s", "l_suppkey", "(SELECT k FROM k)"),
    "s",
    "l_suppkey",
)
ORACLES["sample_error_limit"] = f"""WITH st AS (SELECT l_returnflag AS f, count(*) AS total, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY 1),
ks AS (SELECT f, least(greatest(CAST(ceil(total / (pow(abs(m) * 5.0 / 100 / {z(0.975)!r}, 2) / (d * d / total) + 1)) AS BIGINT), 10), total) AS k, total FROM st),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINEITEM}) AS rn FROM lineitem)
SELECT l_returnflag, count(*) AS n_rows, round(sum(total / k), 4) AS weight, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM r JOIN ks ON f = l_returnflag WHERE rn <= k GROUP BY 1"""
ORACLES["sample_time_slot"] = f"WITH {sample('s', 'event_type, CAST(ts AS DATE)', '5', 'events', EVENT)} SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, max(total) AS total, CAST(sum(event_id) AS BIGINT) AS key_sum FROM s GROUP BY 1, 2"
ORACLES["sample_qcs_expression"] = strata(sample("s", "year(l_shipdate), l_linestatus", "15"), "s", "CAST(year(l_shipdate) AS INTEGER) AS y", "l_linestatus")
ORACLES["sample_dataframe"] = strata(sample("s", "l_linestatus", "40"), "s", "l_linestatus")
NARROW = "md5('quern|' || l_returnflag || '|' || l_linenumber)"
ORACLES["sample_copies"] = f"""WITH r AS (SELECT l_returnflag, l_linenumber, {NARROW} AS h, row_number() OVER (PARTITION BY l_returnflag, l_linenumber) AS i FROM lineitem),
u AS (SELECT *, CASE WHEN i = 1 THEN h ELSE md5(h || '|' || i) END AS u FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY u) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS total FROM u)
SELECT l_returnflag, l_linenumber, count(*) AS n_rows, max(total) AS total FROM s WHERE rn <= 50 GROUP BY 1, 2"""
ORACLES["register_sample"] = "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1"
ORACLES["sample_lookup"] = "SELECT * FROM (VALUES ('flag', 'l_returnflag', 50::BIGINT), ('supp', 'l_suppkey', 20::BIGINT)) v(name, qcs, reservoir)"
ORACLES["error_stats_by_group"] = f"WITH {SUPP} SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 4) AS variance FROM supp GROUP BY 1"
ORACLES["error_estimate_of_average"] = (
    f"WITH {SUPP}, g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS stdev FROM supp GROUP BY 1), e AS (SELECT *, {factor_sql('n', 0.95)} * stdev / sqrt(n) AS e FROM g)"
    " SELECT l_suppkey, round(mean, 4) AS mean, round(stdev, 4) AS stdev, round(e, 4) AS error_estimate, round(abs(e * 100 / mean), 4) AS percent_error FROM e"
)
ORACLES["student_t_cache"] = "SELECT * FROM (VALUES " + ", ".join(f"({d}::BIGINT, {round(t(0.975, d), 6)!r}::DOUBLE)" for d in range(1, 29)) + f", (30::BIGINT, {round(z(0.975), 6)!r}::DOUBLE)) v(df, q)"
ORACLES["populate_on_create"] = "SELECT count(*) AS n FROM lineitem"
ORACLES["insert_into_sample"] = (
    "SELECT l_returnflag, 0 AS batch, least(count(*), 50) AS n_rows, count(*) AS total FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 1, least(count(*), 50), count(*) FROM lineitem WHERE l_quantity > 25 GROUP BY 1"
)
ORACLES["base_insert_propagates"] = "SELECT l_returnflag, count(*) + count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY 1"
ORACLES["truncate_sample"] = "SELECT 0::BIGINT AS n"
ORACLES["drop_sample"] = "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, 0.0::DOUBLE AS e FROM lineitem GROUP BY 1"
ORACLES["scan_sample"] = f"WITH {FLAG} SELECT l_orderkey, l_linenumber FROM flag WHERE l_quantity > 25"
ORACLES["sample_projection"] = f"WITH {FLAG} SELECT l_returnflag, l_orderkey, l_partkey FROM flag"
ORACLES["no_aggregate_exact"] = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45"
ORACLES["weight_propagation"] = f"WITH {FLAG} SELECT l_returnflag AS f, round(sum(l_quantity * 2 * {W}), 4) AS s FROM flag WHERE l_linenumber < 5 GROUP BY 1"
QUANTITY = {"s": ("sum", "l_quantity")}
ORACLES["filter_pre_agg"] = pick(closed(FLAG, "flag WHERE l_linenumber < 4", ["l_returnflag"], QUANTITY), "l_returnflag, round(s, 4) AS s, round(s_absolute_error, 4) AS e")
ORACLES["having_agg"] = pick(closed(SUPP, "supp", ["l_suppkey"], QUANTITY), "l_suppkey, round(s, 4) AS s, round(s_relative_error, 4) AS r", "WHERE s_relative_error > 0.1 AND s > 10")
ORACLES["alias_in_error_fn"] = pick(closed(FLAG, "flag", ["l_returnflag"], {"a": ("avg", "l_quantity")}), "l_returnflag, round(a, 4) AS a, round(a_lower_bound, 4) AS lo, round(a_upper_bound, 4) AS hi")
ORACLES["error_fn_naming"] = pick(closed(FLAG, "flag", [], QUANTITY), 'round(s, 4) AS s, round(s_absolute_error, 4) AS "Absolute_Error(s)", round(s_relative_error, 4) AS "Relative_Error(s)"')
CASES = {"s": ("sum", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END"), "n": ("count", "CASE WHEN l_linenumber > 2 THEN 1 END")}
ORACLES["case_null_agg"] = pick(closed(FLAG, "flag", ["l_returnflag"], CASES), "l_returnflag, round(s, 4) AS s, CAST(trunc(round(n, 6)) AS BIGINT) AS n, round(n_absolute_error, 4) AS e")
ORACLES["join_inner_sample_dim"] = pick(closed(FLAG, "flag JOIN supplier ON l_suppkey = s_suppkey", ["s_nationkey"], {"q": ("sum", "l_quantity")}), "s_nationkey, round(q, 4) AS q, round(q_absolute_error, 4) AS e")
ORACLES["join_left_outer"] = (
    f"WITH {FLAG} SELECT l_returnflag, round(sum(l_quantity * {W}), 4) AS q, CAST(trunc(round(sum(CASE WHEN s_suppkey IS NOT NULL THEN {W} ELSE 0 END), 6)) AS BIGINT) AS n"
    " FROM flag LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey GROUP BY 1"
)
ORACLES["join_right_outer"] = f"WITH {FLAG} SELECT l_returnflag, round(sum(l_quantity * {W}), 4) AS q FROM supplier RIGHT JOIN flag ON l_suppkey = s_suppkey GROUP BY 1"
ORACLES["join_full_outer"] = "SELECT l_returnflag, count(*) AS n FROM lineitem FULL JOIN supplier ON l_suppkey = s_suppkey AND l_quantity > 25 GROUP BY 1"
ORACLES["join_left_semi"] = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1"
ORACLES["join_left_anti"] = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1"
ORACLES["join_subqueries"] = f"WITH {FLAG} SELECT l_returnflag AS f, CAST(trunc(round(sum({W}), 6)) AS BIGINT) AS n, CAST(trunc(round(sum(l_linenumber * {W}), 6)) AS BIGINT) AS s FROM flag GROUP BY 1"
ORACLES["join_analysis_choice"] = """SELECT kind, joins, inner_only, other_distributed, CASE WHEN joins AND (NOT inner_only OR other_distributed OR kind <> 'sum') THEN 'bootstrap' ELSE 'closed_form' END AS analysis
FROM (VALUES ('sum'), ('count'), ('avg')) k(kind), (VALUES (true), (false)) j(joins), (VALUES (true), (false)) i(inner_only), (VALUES (true), (false)) d(other_distributed)"""

KEPT = "supp WHERE l_linenumber > 2"
ORACLES["agg_sum_weighted"] = f"WITH {SUPP} SELECT l_returnflag, round(sum(l_quantity * {W}), 4) AS v FROM {KEPT} GROUP BY 1"
ORACLES["agg_count_weighted"] = f"WITH {SUPP} SELECT l_returnflag, CAST(trunc(round(sum({W}), 6)) AS BIGINT) AS v FROM {KEPT} GROUP BY 1"
ORACLES["agg_avg_weighted"] = f"WITH {SUPP} SELECT l_returnflag, round(sum(l_quantity * {W}) / sum({W}), 4) AS v FROM {KEPT} GROUP BY 1"
LADDER = "CASE WHEN j = 0 THEN 1 " + " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"
for kind in ("sum", "count", "avg"):
    ORACLES[f"agg_{kind}_closedform"] = pick(closed(SUPP, KEPT, ["l_returnflag"], {"v": (kind, "l_quantity")}), shown(["v"], "l_returnflag"))
    e = {"sum": "sum(mult * w * l_quantity)", "count": "sum(mult * w)", "avg": "sum(mult * w * l_quantity) / nullif(sum(mult * w), 0)"}[kind]
    ORACLES[f"agg_{kind}_bootstrap"] = f"""WITH {SUPP},
m AS (SELECT *, {W} AS w, {LADDER} AS mult FROM (SELECT *, CAST('0x' || substr(md5(h || '|' || j), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM {KEPT.split(' WHERE ')[0]}, range({TRIALS}) t(j) WHERE l_linenumber > 2)),
e AS (SELECT l_returnflag, j, CASE WHEN sum(mult) > 0 THEN {e} END AS e FROM m GROUP BY 1, 2),
a AS (SELECT l_returnflag, max(e) FILTER (j = 0) AS v, list_sort(list(e) FILTER (e IS NOT NULL)) AS x FROM e GROUP BY 1),
b AS (SELECT *, x[CAST(floor(len(x) * {(1 - 0.9) / 2!r}::DOUBLE) AS BIGINT) + 1] AS lo, x[CAST(ceil(len(x) * {(1 + 0.9) / 2!r}::DOUBLE) AS BIGINT)] AS hi FROM a)
SELECT l_returnflag, round(v, 4) AS v, round((hi - lo) / 2, 4) AS v_absolute_error, round(abs((hi - lo) / (2 * CASE WHEN abs(v) > 1 THEN v WHEN v >= 0 THEN v + 1 ELSE v - 1 END)), 4) AS v_relative_error, round(lo, 4) AS v_lower_bound, round(hi, 4) AS v_upper_bound FROM b"""
ORACLES["agg_bootstrap_multiplicity"] = f"""WITH {FLAG}, m AS (SELECT l_linestatus, j, {LADDER} AS mult FROM (SELECT *, CAST('0x' || substr(md5(h || '|' || j), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM flag, range({TRIALS}) t(j)))
SELECT l_linestatus, CAST(j AS INTEGER) AS trial, CAST(sum(mult) AS BIGINT) AS rows, sum(mult) > 0 AS there FROM m GROUP BY 1, 2"""
ORACLES["agg_min_max_qcs"] = f"WITH {SUPP} SELECT min(l_suppkey) AS a, max(l_suppkey) AS b, round(sum(l_quantity * {W}), 4) AS s FROM supp"
ORACLES["agg_only_min_max"] = "SELECT min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem"
ORACLES["agg_count_distinct"] = "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, 0.0::DOUBLE AS e, NULL::DOUBLE AS lo FROM lineitem GROUP BY 1"
ORACLES["agg_unsupported"] = "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS d, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1"
ORACLES["join_two_samples"] = f"WITH {FLAG} SELECT l_returnflag, round(sum(l_quantity * {W}), 4) AS q FROM flag JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
FILTERED = {"s": ("sum", "CASE WHEN l_linenumber < 4 THEN l_quantity END"), "n": ("count", "CASE WHEN l_linenumber < 3 THEN 1 END")}
ORACLES["agg_filter_clause"] = pick(closed(FLAG, "flag", ["l_returnflag"], FILTERED), "l_returnflag, round(s, 4) AS s, round(s_absolute_error, 4) AS e, CAST(trunc(round(n, 6)) AS BIGINT) AS n")
ORACLES["alias_with_spaces"] = pick(closed(FLAG, "flag", ["l_returnflag"], QUANTITY), "l_returnflag, round(s, 4) AS s, round(s_absolute_error, 4) AS e")
ORACLES["agg_group_by"] = f"WITH {FLAG} SELECT l_returnflag AS f, l_linenumber % 2 AS odd, CAST(trunc(round(sum({W}), 6)) AS BIGINT) AS n FROM flag GROUP BY 1, 2"
ORACLES["agg_arith_over_agg"] = f"WITH {FLAG} SELECT l_returnflag, round(abs(-sum(l_quantity * {W})) / CAST(trunc(round(sum({W}), 6)) AS BIGINT) + 1, 4) AS v, round(sqrt(sum(l_quantity * {W})), 4) AS w FROM flag GROUP BY 1"
ORACLES["agg_expr_of_errors"] = pick(closed(FLAG, "flag", ["l_returnflag"], QUANTITY), "l_returnflag, round(s, 4) AS s, round(s_upper_bound - s_lower_bound, 4) AS w", "WHERE s_absolute_error > 0")
ORACLES["agg_repeat"] = pick(closed(FLAG, "flag", ["l_returnflag"], QUANTITY), "l_returnflag, round(s, 4) AS a, round(s, 4) AS b, round(s * 2, 4) AS c, round(s_absolute_error, 4) AS e, round(s_absolute_error, 4) AS f")
ORACLES["agg_nested"] = f"WITH {SUPP} SELECT max(n) AS most, round(avg(n), 4) AS mean FROM (SELECT CAST(trunc(round(sum(l_linenumber * {W}), 6)) AS BIGINT) AS n FROM supp GROUP BY l_suppkey)"
ORACLES["sample_prefix_skip"] = f"WITH {FLAG} SELECT l_returnflag, count(*) AS sample_n, CAST(trunc(round(sum({W}), 6)) AS BIGINT) AS n FROM flag GROUP BY 1"
ORACLES["sample_direct_query"] = f"WITH {FLAG} SELECT l_linestatus, CAST(trunc(round(sum(l_linenumber * {W}), 6)) AS BIGINT) AS s FROM flag GROUP BY 1"
ORACLES["agg_rollup"] = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)"
ORACLES["view_sample"] = pick(closed(FLAG, "flag", ["l_returnflag AS f"], {"s": ("sum", "CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END")}), "f, round(s, 4) AS s, round(s_absolute_error, 4) AS e")
for f in FUNCTIONS:
    ORACLES[f] = pick(
        closed(FLAG, "flag", ["l_returnflag"], {"n": ("count", "1"), "s": ("sum", "l_extendedprice")}, 0.9), f"l_returnflag, CAST(trunc(round(n, 6)) AS BIGINT) AS n, round(s, 4) AS s, round(n_{f}, 4) AS of_n, round(s_{f}, 4) AS of_s"
    )

EST = closed(SUPP, "supp", ["l_suppkey"], QUANTITY)
FULL = "x AS (SELECT l_suppkey, sum(l_quantity) AS s FROM lineitem GROUP BY 1)"
PLAIN = "l_suppkey, round(s, 4) AS s, round(s_relative_error, 4) AS r, round(s_lower_bound, 4) AS lo"
BASE = "SELECT l_suppkey, round(s, 4) AS s, 0.0::DOUBLE AS r, NULL::DOUBLE AS lo FROM x"
OVER = f"coalesce(s_relative_error > {HAC_ERROR}, true)"
ORACLES["hac_do_nothing"] = ORACLES["hac_strict"] = pick(EST, PLAIN)
ORACLES["hac_local_omit"] = pick(EST, "l_suppkey, " + ", ".join(f"CASE WHEN NOT {OVER} THEN round({c}, 4) END AS {a}" for c, a in (("s", "s"), ("s_relative_error", "r"), ("s_lower_bound", "lo"))))
ORACLES["hac_run_on_full_table"] = f"WITH {EST}, {FULL} SELECT {PLAIN} FROM est WHERE NOT EXISTS (SELECT 1 FROM est WHERE {OVER}) UNION ALL {BASE} WHERE EXISTS (SELECT 1 FROM est WHERE {OVER})"
PARTIAL = f"WITH {EST}, {FULL} SELECT * FROM (SELECT {PLAIN} FROM est WHERE NOT {OVER} UNION ALL {BASE} WHERE l_suppkey IN (SELECT l_suppkey FROM est WHERE {OVER}))"
ORACLES["hac_partial_run"] = PARTIAL
ORACLES["hac_partial_having"] = PARTIAL + " WHERE s > 500"
ORACLES["hac_partial_no_groupby"] = "SELECT round(sum(l_quantity), 4) AS s, 0.0::DOUBLE AS r FROM lineitem"
ORACLES["hac_inner_limit"] = pick(EST, PLAIN, "ORDER BY s_relative_error, l_suppkey LIMIT 3")
ORACLES["hac_direct_sample_route"] = pick(closed(SUPP, "supp", [], QUANTITY), "round(s, 4) AS s, round(s_absolute_error, 4) AS e")
ORACLES["with_error_api"] = (
    f"WITH {EST}, {FULL} SELECT {shown(['s'], 'l_suppkey')} FROM est WHERE NOT {OVER}"
    f" UNION ALL SELECT l_suppkey, round(s, 4), 0, 0, NULL, NULL FROM x WHERE l_suppkey IN (SELECT l_suppkey FROM est WHERE {OVER})"
)
ORACLES["sort_by_estimate"] = f"WITH {SUPP} SELECT l_suppkey, round(sum(l_quantity * {W}), 4) AS s FROM supp GROUP BY 1 ORDER BY sum(l_quantity * {W}) DESC, 1 LIMIT 10"
ORACLES["sort_by_error_fn"] = pick(EST, "l_suppkey, round(s, 4) AS s, round(s_absolute_error, 4) AS e", "ORDER BY s_absolute_error DESC, l_suppkey LIMIT 10")
ORACLES["limit_topn"] = f"WITH {SUPP} SELECT l_suppkey, round(sum(l_quantity * {W}) / sum({W}), 4) AS a FROM supp GROUP BY 1 ORDER BY sum(l_quantity * {W}) / sum({W}), 1 LIMIT 7"
ORACLES["select_sample"] = "SELECT * FROM (VALUES ('carrier', 'month', 's2'), ('carrier', '', 's3'), ('carrier', 'month year arrdelay', 's3'), ('arrtime', 'month year arrdelay', 's3'), ('tan(arrtime)', 'month year arrdelay', 's4')) v(grouping, filtering, sample)"

SLOT = f"CAST((epoch_ms(ts) - {EPOCH}) // {DAY} AS BIGINT)"
TOP = "SELECT user_id AS key, CAST({n} AS BIGINT) AS estimated_value FROM events WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"
ORACLES["topk_batch"] = ORACLES["stream_populate"] = TOP.format(n="count(*)", where="true", k=10)
ORACLES["topk_frequency_col"] = TOP.format(n="sum(CAST(trunc(value) AS BIGINT))", where="true", k=10)
ORACLES["topk_time_range"] = TOP.format(n="count(*)", where=f"{SLOT} BETWEEN 2 AND 8", k=10)
ORACLES["topk_between"] = TOP.format(n="count(*)", where=f"{SLOT} >= 5", k=5)
ORACLES["insert_topk"] = TOP.format(n="2 * count(*)", where="true", k=5)
ORACLES["truncate_topk"] = TOP.format(n="count(*)", where="event_type = 'click'", k=5)
ORACLES["topk_current"] = "SELECT event_type AS key, count(*) AS estimated_value FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"
ORACLES["create_topk_table"] = f"SELECT event_type AS key, count(DISTINCT (epoch_ms(ts) - {EPOCH}) // 3600000) AS slots, count(*) AS n FROM events GROUP BY 1"
ORACLES["topk_sql"] = f"SELECT user_id, count(*) AS n, make_timestamp(({EPOCH} + min({SLOT}) * {DAY}) * 1000) AS first FROM events WHERE {SLOT} >= 1 GROUP BY 1"
ORACLES["scan_topk"] = f"SELECT user_id, count(*) AS n FROM events WHERE {SLOT} = 2 GROUP BY 1"
ORACLES["drop_topk"] = "SELECT 0::BIGINT AS tables"


def cell(key: str, row: str, width: int) -> str:
    return f"CAST(CAST('0x' || substr(md5({row} || '|' || {key}), 1, 13) AS BIGINT) % {width} AS BIGINT)"


def sketch(name: str, where: str = "true", by: str = "", width: int = CMS.width) -> str:
    return f"{name} AS (SELECT {by}CAST(r AS INTEGER) AS row, {cell('user_id', 'r', width)} AS col, count(*) AS n FROM events, range({CMS.depth}) t(r) WHERE {where} GROUP BY ALL)"


def estimates(name: str, of: str, where: str = "true") -> str:
    return f"{name} AS (SELECT user_id AS key, min(coalesce(n, 0)) AS estimate FROM (SELECT DISTINCT user_id FROM events WHERE {where}), range({CMS.depth}) t(r) LEFT JOIN {of} ON row = r AND col = {cell('user_id', 'r', CMS.width)} GROUP BY 1)"


ORACLES["cms_add"] = ORACLES["cms_merge"] = f"WITH {sketch('s')} SELECT row, col, n FROM s"
ORACLES["cms_compress"] = f"WITH {sketch('s', width=CMS.width // 2)} SELECT row, col, n FROM s"
ORACLES["cms_estimate"] = f"WITH {sketch('s')}, {estimates('e', 's')} SELECT key, estimate FROM e"
ORACLES["cms_params"] = "SELECT * FROM (VALUES " + ", ".join(f"({e}::DOUBLE, {c}::DOUBLE, {CmsParams.of(e, c).depth}::BIGINT, {CmsParams.of(e, c).width}::BIGINT)" for e in (0.001, 0.01, 0.05) for c in (0.9, 0.95, 0.99)) + ") v(eps, confidence, depth, width)"
ORACLES["cms_bounds"] = f"WITH {sketch('s')}, {estimates('e', 's')} SELECT key, CAST(greatest(floor(estimate - (SELECT count(*) FROM events) * {CMS.eps!r}::DOUBLE), 0) AS BIGINT) AS lower_bound, estimate, estimate AS max FROM e"
ORACLES["approximate_arith"] = f"""WITH n AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1),
a AS (SELECT *, CAST(greatest(floor(n - n * 10 * {CMS.eps!r}::DOUBLE), 0) AS BIGINT) AS la, CAST(greatest(floor(n * 2 - n * 10 * {CMS.eps!r}::DOUBLE), 0) AS BIGINT) AS lb FROM n)
SELECT key, la + lb AS add_low, 3 * n AS add_max, lb - n AS sub_low, 2 * n - la AS sub_max FROM a"""
ORACLES["topk_cms"] = f"WITH {sketch('s')}, {estimates('e', 's')} SELECT key, estimate AS estimated_value FROM e ORDER BY 2 DESC, 1 LIMIT 10"
ORACLES["topk_cms_merge"] = f"""WITH {sketch('s', f'{SLOT} < 10')}, {sketch('r', f'{SLOT} >= 10')}, {estimates('e', 's', f'{SLOT} < 10')}, {estimates('f', 'r', f'{SLOT} >= 10')}
SELECT key, CAST(sum(estimate) AS BIGINT) AS estimated_value FROM (SELECT * FROM e UNION ALL SELECT * FROM f) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
ORACLES["hokusai_time_agg"] = f"SELECT CAST(l AS INTEGER) AS level, {SLOT} >> l AS block, count(DISTINCT user_id) AS n_keys, count(*) AS n FROM events, range({LEVELS}) t(l) GROUP BY 1, 2"
#: Decaying sketches, by their definition: 3 rows of 4096 columns over hours, halved at ages 2, 4 and 8.
HOUR = f"CAST((epoch_ms(ts) - {EPOCH}) // 3600000 AS BIGINT)"
AGED = f"""z AS (SELECT max({HOUR}) AS z FROM events),
w AS (SELECT t, CAST(CASE WHEN z - t < 2 THEN 4096 WHEN z - t < 4 THEN 2048 WHEN z - t < 8 THEN 1024 ELSE 512 END AS BIGINT) AS w FROM z, (SELECT CAST(unnest(range((SELECT z + 1 FROM z))) AS BIGINT) AS t)),
d AS (SELECT {HOUR} AS t, user_id, CAST(r AS INTEGER) AS row, {cell('user_id', 'r', 4096)} AS wide FROM events, range(3) s(r)),
own AS (SELECT t, row, wide % w AS col, count(*) AS n FROM d JOIN w USING (t) GROUP BY ALL)"""
ORACLES["hokusai_item_agg"] = f"WITH {AGED} SELECT t AS slot, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n, CAST(sum(col * n) AS BIGINT) AS col_sum FROM own GROUP BY 1"
ORACLES["hokusai_blocks"] = f"""WITH {AGED}, l AS (SELECT CAST(l AS INTEGER) AS level, length(bin(z)) AS top, z FROM z, range(1, 21) x(l) WHERE l <= length(bin(z)))
SELECT level, t >> level AS block, count(DISTINCT (row, wide)) AS cells, count(*) AS n FROM d, l
WHERE level = top OR z - (((t >> level) + 1) * (1::BIGINT << level) - 1) < (2::BIGINT << level) GROUP BY 1, 2"""


def shared(lo: int, hi: int) -> str:
    """Slots lo to hi, all of one block at the level of the age of lo."""
    return f"""WITH {AGED}, b AS (SELECT length(bin(z - {lo})) - 1 AS level, ({lo}::BIGINT >> (length(bin(z - {lo})) - 1)) AS block FROM z),
k AS (SELECT DISTINCT user_id, row, wide FROM (SELECT user_id FROM events), (SELECT CAST(r AS INTEGER) AS row, r FROM range(3) s(r)), LATERAL (SELECT {cell('user_id', 'r', 4096)} AS wide)),
m AS (SELECT row, wide, count(*) AS m FROM d, b WHERE t >> level = block GROUP BY 1, 2),
c AS (SELECT row, w, col, sum(n) AS s, sum(CASE WHEN t BETWEEN {lo} AND {hi} THEN n ELSE 0 END) AS a FROM own JOIN w USING (t), b WHERE t >> level = block GROUP BY 1, 2, 3),
f AS (SELECT user_id, k.row, wide, coalesce(sum(s), 0) AS s, coalesce(sum(a), 0) AS a FROM k CROSS JOIN (SELECT DISTINCT w FROM w, b WHERE t >> level = block) v LEFT JOIN c ON c.row = k.row AND c.w = v.w AND c.col = wide % v.w GROUP BY 1, 2, 3),
g AS (SELECT user_id, min(a) AS own, min(coalesce(m * a / nullif(s, 0), 0)) AS part FROM f LEFT JOIN m USING (row, wide) GROUP BY 1)
SELECT user_id AS key, CAST(CASE WHEN own > exp(1) * (SELECT sum(a) FROM c WHERE row = 0) / (SELECT min(w) FROM w, b WHERE t >> level = block) THEN own ELSE floor(part) END AS BIGINT) AS estimate FROM g"""


ORACLES["hokusai_point"], ORACLES["hokusai_interpolate"] = shared(100, 100), shared(3, 50)
NARROW_SKETCH = f"c AS (SELECT r, {cell('user_id', 'r', 64)} AS col, count(*) AS n FROM events, range(5) s(r) WHERE {SLOT} BETWEEN 2 AND 8 GROUP BY ALL)"
ORACLES["topk_sketched"] = f"""WITH {NARROW_SKETCH}, k AS (SELECT DISTINCT user_id FROM events WHERE {SLOT} BETWEEN 2 AND 8),
e AS (SELECT user_id AS key, min(n) AS estimated_value FROM k, range(5) s(r) JOIN c ON c.r = s.r AND col = {cell('user_id', 's.r', 64)} GROUP BY 1)
SELECT *, CAST(greatest(floor(estimated_value - (SELECT sum(n) FROM c WHERE r = 0) * (exp(1) / 64)), 0) AS BIGINT) AS lower_bound, estimated_value AS max FROM e ORDER BY 2 DESC, 1 LIMIT 10"""
ORACLES["topk_stream_summary"] = f"""WITH n AS (SELECT event_type = 'click' AS part, {SLOT} AS slot, user_id, count(*) AS n FROM events WHERE {SLOT} < 7 GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY part, slot ORDER BY n DESC, user_id) AS i FROM n),
f AS (SELECT part, slot, coalesce(max(n) FILTER (i > 20), 0) AS floor FROM o GROUP BY 1, 2),
k AS (SELECT DISTINCT slot, user_id FROM o WHERE i <= 20)
SELECT k.user_id, CAST(sum(coalesce(o.n, floor)) AS BIGINT) AS n, CAST(sum(CASE WHEN o.n IS NULL THEN floor ELSE 0 END) AS BIGINT) AS delta, make_timestamp(({EPOCH} + k.slot * {DAY}) * 1000) AS start
FROM k JOIN f USING (slot) LEFT JOIN o ON o.part = f.part AND o.slot = k.slot AND o.user_id = k.user_id AND o.i <= 20 GROUP BY k.slot, 1"""
ORACLES["hokusai_till"] = f"SELECT user_id AS key, count(*) AS n FROM events WHERE {SLOT} >= (SELECT max({SLOT}) - 6 FROM events) GROUP BY 1"
ORACLES["hokusai_between"] = f"SELECT user_id AS key, count(*) AS n FROM events WHERE {SLOT} BETWEEN 3 AND 17 GROUP BY 1"
ORACLES["hokusai_late_data"] = f"SELECT {SLOT} AS slot, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM events GROUP BY 1"
ORACLES["interval_tracker"] = "SELECT * FROM (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, '{' '.join(f'{v}:{k}' for v, k in cover(a, b, LEVELS))}')" for a in range(8) for b in range(a, 16)) + ") v(first, last, blocks)"
ORACLES["stream_summary"] = f"""SELECT slot, key, estimate, 0::BIGINT AS delta_error FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY estimate DESC, key) AS r
FROM (SELECT {SLOT} AS slot, user_id AS key, count(*) AS estimate FROM events GROUP BY 1, 2) WHERE slot < 20) WHERE r <= 3"""
ORACLES["save_stream"] = "SELECT upper(event_type) AS key, count(*) AS estimated_value FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
ORACLES["stream_event_time"] = f"SELECT CAST((epoch_ms(ts) - {EPOCH}) // 21600000 AS BIGINT) AS slot, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES["stream_late_data"] = f"SELECT {SLOT} AS slot, count(*) + count(*) FILTER (ts < '2024-01-05') AS n FROM events GROUP BY 1"
ORACLES["stream_epoch"] = "SELECT CAST((epoch_ms(ts) - (SELECT epoch_ms(min(ts)) FROM events)) // 43200000 AS BIGINT) AS slot, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES["stream_window_cq"] = "SELECT CAST(ts AS DATE)::TIMESTAMP - to_days(CAST(k AS INTEGER)) AS start, event_type, count(*) AS n FROM events, range(2) t(k) GROUP BY 1, 2"
ORACLES["scan_parquet"] = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49"
ORACLES["window_over_aggregate"] = "SELECT l_returnflag, l_linenumber, CAST(sum(l_orderkey) AS BIGINT) AS s, round(avg(sum(l_orderkey)) OVER (PARTITION BY l_returnflag), 4) AS mean FROM lineitem GROUP BY 1, 2"
