"""The engine: SQL with error clauses, samples, top-K tables, and the DataFrame way to the same."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import errors
from .operators import contract, estimators
from .operators._tables import shared_folder
from .operators.estimators import Agg
from .operators.sampling import CARRIED, HIDDEN, ROW, STRATUM, SampleOptions, stratified_sample
from .operators.topk import millis
from .plans import clause as clauses
from .plans import rewrite, selection, text
from .plans.clause import Settings
from .plans.text import Block, NotUnderstoodError
from .sources import ddl
from .sources.registry import Registry, SampleTable


@dataclass(frozen=True)
class PlanInfo:
    """What the last query did: for tests, and for those who wonder."""

    error: float | None
    confidence: float | None
    behavior: str | None
    analysis: str
    trials: int
    sample: str | None
    routed: bool = False


@dataclass
class _Source:
    """A FROM clause with a sample in place of a base table."""

    sql: str
    exact: str
    sample: SampleTable | None
    joins: bool
    inner_only: bool
    other_distributed: bool
    explicit: bool


EXACT = PlanInfo(None, None, None, selection.EXACT, 0, None)


class AqpSession:
    """conf keys: error, confidence, behavior, closed_form, trials, count_as_minus_one.

    root: a folder that outlives the session; tables made there are there again for the next one.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, **conf):
        self.spark = spark
        self.registry = Registry(spark, kept=bool(root), root=root or f"{shared_folder(spark)}/quern-tables-{uuid.uuid4().hex}")
        self.conf = {"closed_form": True, "trials": 100, "count_as_minus_one": False} | conf
        self.views: dict[str, str] = {}
        self.last_plan_info = EXACT
        self._names = 0

    # Statements

    def sql(self, statement: str) -> DataFrame | None:
        if made := ddl.parse(statement):
            if made.kind or made.name.lower() in self.registry.samples or made.name.lower() in self.registry.topks:
                return self._statement(made)
        if m := re.match(r"\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+`?(\w+)`?\s+as\s+(.*)$", statement, re.I | re.S):
            return self.create_view(m[1], m[2])
        if m := re.match(r"\s*insert\s+into\s+(?:table\s+)?`?(\w+)`?\s+(.*)$", statement, re.I | re.S):
            known = m[1].lower() in self.registry.samples or m[1].lower() in self.registry.topks or self.registry.depends(m[1])
            if not known and not self.spark.catalog.getTable(m[1]).isTemporary:
                return self.spark.sql(statement)
            return self.insert_into(m[1], self.spark.sql(m[2] if not re.match(r"values", m[2], re.I) else f"SELECT * FROM {m[2]}"))
        query, clause = clauses.strip(statement)
        return self.query(query, clauses.resolve(clause, self.conf))

    def _statement(self, s: ddl.Statement) -> None:
        r = self.registry
        topk = s.kind == "TOPK" or s.name.lower() in r.topks
        if s.verb == "DROP":
            (r.drop_topk if topk else r.drop_sample)(s.name, s.lenient)
        elif s.verb == "TRUNCATE":
            (r.truncate_topk if topk else r.truncate_sample)(s.name)
        elif topk:
            r.create_topk(s.name, s.options, s.base, s.lenient)
        else:
            rows = self.spark.sql(s.query) if s.query else self.spark.createDataFrame([], s.schema) if s.schema and not s.base and "basetable" not in {k.lower() for k in s.options} else None
            r.create_sample(s.name, s.options, s.base, rows, s.lenient)

    def create_view(self, name: str, query: str) -> None:
        """A view that queries see through to its base tables' samples."""
        self.views[name.lower()] = query
        self.spark.sql(self._without_views(query)).createOrReplaceTempView(name)

    def _without_views(self, query: str) -> str:
        return clauses.strip(query)[0]

    def insert_into(self, table: str, rows: DataFrame, overwrite: bool = False) -> None:
        """Into a sample (drawn as a batch of its own), a top-K table, or a base with all that depends on it."""
        if table.lower() in self.registry.samples:
            self.registry.insert_sample(table, rows, overwrite)
        elif table.lower() in self.registry.topks:
            self.registry.insert_topk(table, rows)
        else:
            self.registry.insert_base(table, rows)

    # Queries

    def query(self, sql: str, settings: Settings | None) -> DataFrame:
        self.last_plan_info = EXACT
        named, body = text.ctes(sql)
        views = self.views | named
        try:
            block = text.block(body)
            if not rewrite.has_aggregate(block):
                return self._outer(block, sql, settings, views)
            plan = rewrite.plan(block)
        except NotUnderstoodError:
            return self._plain(sql)
        source = self._source(block.source, views, plan, settings is not None)
        if source is None or source.sample is None:
            return self._outer(block, sql, settings, views)
        if settings is None:  # a sample that is named is weighted without a clause as well
            settings = Settings(float("inf"), float(self.conf.get("confidence", clauses.DEFAULT_CONFIDENCE)), "DO_NOTHING")
        return self._approximate(plan, source, settings)

    def _plain(self, sql: str) -> DataFrame:
        """Exactly, error functions being those of exact values."""
        used = text.calls(sql, rewrite.ERRORS)
        for c in reversed(used):
            value = "CAST(0.0 AS DOUBLE)" if c.name in ("absolute_error", "relative_error") else "CAST(NULL AS DOUBLE)"
            follows = re.match(r"\s+(?:as\b|(?!from\b|asc\b|desc\b|and\b|or\b)[a-z_]\w*)", text.masked(sql)[c.end :], re.I)
            before = re.search(r"(?:\bselect|,)\s*$", text.masked(sql)[: c.start], re.I)
            name = f" AS `{errors.display_name(c.name, c.arg)}`" if before and not follows else ""
            sql = sql[: c.start] + value + name + sql[c.end :]
        return self._run(sql)

    def _run(self, sql: str) -> DataFrame:
        for name in self.registry.samples:
            if re.search(rf"\b{re.escape(name)}\b", text.masked(sql), re.I):
                self.registry.read_sample(name).drop(*HIDDEN).createOrReplaceTempView(name)
        for name in self.registry.topks:
            if re.search(rf"\b{re.escape(name)}\b", text.masked(sql), re.I):
                self.topk_view(name).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def _view(self, df: DataFrame, name: str = "part") -> str:
        self._names += 1
        made = f"quern_{name}_{self._names}"
        df.createOrReplaceTempView(made)
        return made

    def _outer(self, block: Block, sql: str, settings: Settings | None, views: dict[str, str]) -> DataFrame:
        """A query over derived tables: those that aggregate a sampled table are estimated, the rest is Spark's."""
        if settings is None:
            return self._plain(sql)
        source, done = block.source, None
        for ref in reversed(text.tables(block.source)):
            query = ref.query or views.get(ref.name or "")
            if query is None:
                continue
            try:
                inner = text.block(text.ctes(query)[1])
                if not rewrite.has_aggregate(inner):
                    continue
            except NotUnderstoodError:
                continue
            view = self._view(self.query(query, settings))
            done = self.last_plan_info if self.last_plan_info.sample else done
            source = source[: ref.start] + f"{view} AS {ref.alias or ref.name or view}" + source[ref.end :]
        if done is None:
            return self._plain(sql)
        self.last_plan_info = done
        head = sql[: len(sql) - len(text.ctes(sql)[1])]
        return self.spark.sql(head + block.sql(source=source))

    # FROM clauses

    def _source(self, source: str, views: dict[str, str], plan: rewrite.Plan, clause: bool) -> _Source | None:
        """source with the best sample in place of the first base that may have one; None if none may."""
        try:
            refs = text.tables(source)
        except NotUnderstoodError:
            return None
        explicit = [r for r in refs if r.name in self.registry.samples]
        if len(explicit) > 1:
            raise ValueError("only one sample table may be named in a FROM clause")
        inner_only = all(r.join in ("", "inner", "cross") for r in refs)
        for i, ref in enumerate(refs):
            if not self._may_stand(refs, i):
                continue
            if ref.name in self.registry.samples:
                table = self.registry.sample(ref.name)
                made = self._view(self.registry.read_sample(ref.name), "sample"), table.base or ref.name, table
            elif not clause:
                continue
            elif ref.name and self.registry.samples_of(ref.name):
                table = self._choose(ref.name, plan)
                if table is None:
                    continue
                made = self._view(self.registry.read_sample(table.name), "sample"), ref.name, table
            elif query := ref.query or views.get(ref.name or ""):
                inside = self._inside(query, views, plan)
                if inside is None:
                    continue
                made = inside
            else:
                continue
            sampled, base, table = made
            alias = ref.alias or ref.name or "quern_part"
            others = [r for j, r in enumerate(refs) if j != i]
            distributed = any((r.name or "") not in self.registry.replicated for r in others)
            put = lambda name: source[: ref.start] + f"{name} AS {alias}" + source[ref.end :]
            return _Source(put(sampled), put(base), table, bool(others), inner_only, distributed, ref.name in self.registry.samples)
        return None

    @staticmethod
    def _may_stand(refs: list[text.TableRef], i: int) -> bool:
        """Whether a sample at place i keeps the join's meaning: never on a side that is padded."""
        for j, r in enumerate(refs):
            if j == 0:
                continue
            allowed = ("inner", "cross") + (("left", "left outer") if i < j else ("right", "right outer") if i == j else ())
            if i <= j and r.join not in allowed:
                return False
        return True

    def _inside(self, query: str, views: dict[str, str], plan: rewrite.Plan) -> tuple[str, str, SampleTable] | None:
        """A derived table or view without aggregates, with the hidden columns carried through."""
        try:
            inner = text.block(text.ctes(query)[1])
        except NotUnderstoodError:
            return None
        if rewrite.has_aggregate(inner) or inner.distinct or inner.limit:
            return None
        found = self._source(inner.source, views, plan, True)
        if found is None:
            return None
        return f"({inner.sql([*inner.items, *CARRIED], found.sql)})", f"({inner.sql(source=found.exact)})", found.sample

    def _choose(self, base: str, plan: rewrite.Plan) -> SampleTable | None:
        of = [selection.Candidate(s.name, frozenset(map(selection.normal, s.options.qcs)), s.options.fraction, s.options.bypass) for s in self.registry.samples_of(base)]
        group = {selection.normal(g) for g in plan.groups}
        extremes = {selection.normal(plan.args[a.arg]) for a in plan.aggs if a.kind in ("min", "max") and a.arg in plan.args and not re.fullmatch(r"[\d.]+|'.*'", plan.args[a.arg])}
        chosen = selection.select_sample(of, group, rewrite.where_columns(plan.block.where), extremes)
        return self.registry.sample(chosen.name) if chosen else None

    # Estimation

    def _approximate(self, plan: rewrite.Plan, source: _Source, s: Settings) -> DataFrame:
        behavior = s.behavior
        routes = behavior in ("RUN_ON_FULL_TABLE", "PARTIAL_RUN_ON_BASE_TABLE")
        if source.explicit and routes:
            behavior = "STRICT"
        limit = s.error
        having_on_group = bool(re.search(r"\bg\d+\b", plan.having))
        analysis = selection.choose_analysis(
            {a.kind for a in plan.aggs},
            filtered=bool(plan.block.where),
            having_on_group=having_on_group,
            closed_form=bool(self.conf["closed_form"]),
            joins=source.joins,
            inner_only=source.inner_only,
            other_distributed=source.other_distributed,
            error_functions=plan.uses_errors,
            behavior=behavior,
        )
        trials = int(self.conf["trials"]) if analysis == selection.BOOTSTRAP else 0
        if analysis == selection.EXACT:
            return self._plain(plan.block.sql(source=source.exact))
        by = {f"g{i}": F.col(f"g{i}") for i in range(len(plan.groups))}
        rows = self.spark.sql(plan.input_sql(source.sql, True))
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        types = {a.alias: estimators.exact_type(a.kind, kinds.get(a.arg)) for a in plan.aggs}
        exact_rows = lambda: self.spark.sql(plan.input_sql(source.exact, False))
        groups = self._estimate(rows, by, plan.aggs, analysis, s.confidence, trials)

        def typed(df: DataFrame) -> DataFrame:
            return df.withColumns({a.alias: F.round(F.col(a.alias), 6).cast(types[a.alias]) if "int" in types[a.alias].simpleString() else F.col(a.alias).cast(types[a.alias]) for a in plan.aggs})

        groups, routed = typed(groups), False
        whole = lambda: typed(estimators.exact(exact_rows(), by, plan.aggs))
        if analysis == selection.BYPASS:
            pass
        elif behavior == "LOCAL_OMIT":
            groups = contract.local_omit(groups, plan.aggs, limit, bool(self.conf["count_as_minus_one"]))
        elif behavior == "RUN_ON_FULL_TABLE":
            groups = contract.run_on_full_table(groups, plan.aggs, limit, lambda: whole().withColumn("__full", F.lit(True)))
            routed = "__full" in groups.columns
            groups = groups.drop("__full")
        elif behavior == "PARTIAL_RUN_ON_BASE_TABLE":
            some = lambda keys: typed(estimators.exact(contract.rows_of(exact_rows(), by, keys), by, plan.aggs))
            groups = contract.partial_run(groups, list(by), plan.aggs, limit, some, whole)
        self.last_plan_info = PlanInfo(s.error, s.confidence, behavior, analysis, trials, source.sample.name, routed)
        result = self._project(plan, groups, behavior == "STRICT" and analysis != selection.BYPASS)
        if behavior == "STRICT" and analysis != selection.BYPASS:
            kept = contract.strict(result, plan.aggs, limit)
            result = kept.select(*[F.col(f"`{c}`") for c in kept.columns[: len(plan.items)]])
        return result

    def _estimate(self, rows: DataFrame, by: dict[str, Column], aggs: list[Agg], analysis: str, confidence: float, trials: int) -> DataFrame:
        if analysis == selection.BYPASS:
            groups = estimators.weighted(rows, by, aggs)
            none = F.lit(None).cast("double")
            return groups.withColumns({errors.column(f, a.alias): (F.lit(0.0) if f.endswith("_error") else none) for a in aggs for f in errors.FUNCTIONS})
        if analysis == selection.CLOSED_FORM:
            return estimators.closed_form(rows, by, aggs, confidence)
        return estimators.bootstrap(rows, by, aggs, F.col(ROW), confidence, trials)

    def _project(self, plan: rewrite.Plan, groups: DataFrame, with_errors: bool) -> DataFrame:
        view = self._view(groups, "groups")
        items = [f"{e} AS `{n}`" for e, n in plan.items]
        if with_errors:
            items += [errors.column("relative_error", a.alias) for a in contract.estimated(plan.aggs)]
        sql = f"SELECT {', '.join(items)} FROM {view}" + f" WHERE {plan.having}" * bool(plan.having)
        return self.spark.sql(sql + f" ORDER BY {plan.order}" * bool(plan.order) + f" LIMIT {plan.block.limit}" * bool(plan.block.limit))

    # DataFrames

    def stratified_sample(self, df: DataFrame, options: dict | SampleOptions, register_as: str | None = None, base: str | None = None) -> DataFrame:
        made = options if isinstance(options, SampleOptions) else SampleOptions.parse(options)
        if register_as:
            self.registry.create_sample(register_as, made, base, df)
            return self.registry.read_sample(register_as)
        return stratified_sample(df, made)

    def with_error(self, sample: DataFrame, by: list[str], aggs: list[tuple[str, str, str]], error: float, confidence: float = 0.95, behavior: str = "DO_NOTHING", base: DataFrame | None = None, where: str | None = None) -> DataFrame:
        """Estimates over a sample DataFrame: aggs are (kind, expression, alias). Groups with
        their error columns; routing behaviors need the base."""
        if not 0 < error <= 1 or not 0 < confidence <= 1:
            raise ValueError("error and confidence must lie between 0 and 1")
        behavior = clauses.check_behavior(behavior)
        if STRATUM not in sample.columns:
            raise ValueError("not a sample: it lacks the hidden columns")
        made, groups_by = [Agg(*a) for a in aggs], {b: F.expr(b) for b in by}
        rows = sample.filter(where) if where else sample
        analysis = selection.choose_analysis({a.kind for a in made}, filtered=bool(where), closed_form=bool(self.conf["closed_form"]), error_functions=True)
        trials = int(self.conf["trials"])
        groups = self._estimate(rows, groups_by, made, analysis, confidence, trials)
        full = lambda: estimators.exact(base.filter(where) if where else base, groups_by, made)
        if behavior == "LOCAL_OMIT":
            groups = contract.local_omit(groups, made, error)
        elif behavior == "STRICT" or behavior != "DO_NOTHING" and base is None:
            groups = contract.strict(groups, made, error)
        elif behavior == "RUN_ON_FULL_TABLE":
            groups = contract.run_on_full_table(groups, made, error, full)
        elif behavior == "PARTIAL_RUN_ON_BASE_TABLE":
            rest = lambda keys: estimators.exact(contract.rows_of(base.filter(where) if where else base, groups_by, keys), groups_by, made)
            groups = contract.partial_run(groups, by, made, error, rest, full)
        self.last_plan_info = PlanInfo(error, confidence, behavior, analysis, trials if analysis == selection.BOOTSTRAP else 0, None)
        return groups

    # Top-K

    def topk_view(self, name: str) -> DataFrame:
        """A top-K table for SQL: key, EstimatedValue, ErrorBoundsInfo (of a stream summary: DeltaError),
        StartTime, EndTime by slot. Sketches bound a slot above only."""
        table, o = self.registry.topk(name), self.registry.topk(name).options
        rows = self.registry.read_topk(name)
        start = F.col("slot") * o.interval_ms + (table.epoch_ms or 0)
        if o.stream_summary:
            error = F.col("delta").alias("DeltaError")
        else:
            bounds = F.col("n").alias("lowerBound"), F.col("n").alias("estimate"), F.col("n").alias("max"), F.lit(1.0).alias("confidence")
            if o.sketched:
                bounds = F.lit(None).cast("bigint").alias("lowerBound"), *bounds[1:3], F.lit(o.cms.confidence).alias("confidence")
            error = F.struct(*bounds).alias("ErrorBoundsInfo")
        return rows.select(F.col("key").alias(o.key if o.key.isidentifier() else "key"), F.col("n").alias("EstimatedValue"), error, F.timestamp_millis(start).alias("StartTime"), F.timestamp_millis(start + o.interval_ms).alias("EndTime"))

    def query_approx_topk(self, name: str, k: int | None = None, start=None, end=None) -> DataFrame:
        """The k largest keys; times are epoch milliseconds or timestamp text, and null is open."""

        def ms(x):
            if x is None or isinstance(x, int):
                return x
            return self.spark.range(1).select(millis(F.expr(f"timestamp '{x}'")).alias("t")).first().t

        return self.registry.query_topk(name, k, ms(start), ms(end))
