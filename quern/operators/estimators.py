"""Estimates of SUM, COUNT and AVG over a stratified sample, plain, closed-form and bootstrap.

Every estimator takes the rows that reach the aggregate, still with the sample's hidden columns,
and the group columns by name, and gives one row per group: the estimate of each aggregate under
its alias and, but for the plain one, four error columns beside it. All state is partial sums, so Catalyst combines on the
map side; nothing but groups is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import errors
from ..functions.quantiles import factor
from .sampling import STRATUM, TAKEN, TOTAL


@dataclass(frozen=True)
class Agg:
    """One aggregate: kind sum, count, avg, min or max; arg an SQL expression, * for all rows.

    An alias that starts with `sample_` asks for the sample's own rows, unweighted.
    """

    kind: str
    arg: str
    alias: str

    @property
    def plain(self) -> bool:
        return self.alias.lower().startswith("sample_")

    def value(self) -> Column:
        if self.arg.strip() == "*":
            return F.lit(1.0)
        args = [F.expr(self.arg)] if self.kind != "count" else [F.expr(a) for a in _arguments(self.arg)]
        if self.kind == "count":
            there = args[0].isNotNull()
            for a in args[1:]:
                there = there & a.isNotNull()
            return F.when(there, F.lit(1.0))
        return args[0].cast("double")


def _arguments(text: str) -> list[str]:
    from .sampling import split_list

    return split_list(text)


def weight() -> Column:
    """Rows that a sampled row stands for; 1 where nothing was taken."""
    return F.when(F.col(TAKEN) > 0, F.col(TOTAL) / F.col(TAKEN)).otherwise(F.lit(1.0))


def _group(df: DataFrame, by: dict[str, Column]):
    return df.groupBy(*[c.alias(n) for n, c in by.items()])


def exact(df: DataFrame, by: dict[str, Column], aggs: list[Agg]) -> DataFrame:
    """The aggregates themselves, with error columns of exact values."""
    made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    out = []
    for a in aggs:
        if a.kind == "count":
            c = F.count("*") if a.arg.strip() == "*" else F.count(a.value())
        else:
            c = made[a.kind](F.expr(a.arg))
        out += [c.alias(a.alias), *[e.alias(errors.column(f, a.alias)) for f, e in errors.exact().items()]]
    return _group(df, by).agg(*out)


def _own(a: Agg) -> list[Column]:
    """min, max and unweighted aggregates, which have no error."""
    if a.kind in ("min", "max"):
        return [getattr(F, a.kind)(F.expr(a.arg)).alias(a.alias)]
    v = a.value()
    return [{"count": F.count(v), "sum": F.sum(v), "avg": F.avg(v)}[a.kind].alias(a.alias)]


def exact_type(kind: str, arg: T.DataType | None) -> T.DataType:
    """The type that Spark gives the exact aggregate, which an estimate is cast back to."""
    if kind == "count":
        return T.LongType()
    if kind in ("min", "max"):
        return arg
    if isinstance(arg, T.DecimalType):
        more, scale = (4, 4) if kind == "avg" else (10, 0)
        return T.DecimalType(min(arg.precision + more, 38), min(arg.scale + scale, 38))
    return T.LongType() if kind == "sum" and isinstance(arg, T.IntegralType) else T.DoubleType()


def weighted(df: DataFrame, by: dict[str, Column], aggs: list[Agg]) -> DataFrame:
    """Weighted estimates alone."""
    w, out = weight(), []
    for a in aggs:
        if a.plain or a.kind in ("min", "max"):
            out += _own(a)
            continue
        v = a.value()
        n = F.sum(F.when(v.isNotNull(), w))
        out.append({"sum": F.sum(w * v), "count": F.coalesce(n, F.lit(0.0)), "avg": F.sum(w * v) / n}[a.kind].alias(a.alias))
    return _group(df, by).agg(*out)


def closed_form(df: DataFrame, by: dict[str, Column], aggs: list[Agg], confidence: float = 0.95) -> DataFrame:
    """Stratified estimates with the textbook variance.

    A stratum's variance divides by all of its sampled rows, those that a filter dropped counted
    as zeros; with one sampled row, or all rows taken, it is zero.
    """
    names = [f"g{i}" for i in range(len(by))]
    first, second = [], []
    for i, a in enumerate(aggs):
        if a.plain or a.kind in ("min", "max"):
            first += [c.alias(f"own{i}") for c in (_own(a) if a.kind != "avg" else [F.sum(a.value())])]
            if a.kind == "avg":
                first.append(F.count(a.value()).alias(f"ownn{i}"))
            continue
        v = a.value()
        first += [F.count(v).alias(f"c{i}"), F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}")]
    strata = df.groupBy(*[c.alias(n) for c, n in zip(by.values(), names)], F.col(STRATUM), F.col(TAKEN).alias("n"), F.col(TOTAL).alias("t")).agg(*first)
    n, t = F.col("n"), F.col("t")
    w = F.when(n > 0, t / n).otherwise(F.lit(1.0))
    m = F.when(n > 1, t * (t - n) / (n - 1)).otherwise(F.lit(0.0))
    for i, a in enumerate(aggs):
        if a.plain or a.kind in ("min", "max"):
            f = {"min": F.min, "max": F.max}.get(a.kind, F.sum)
            second.append(f(f"own{i}").alias(f"own{i}"))
            if a.kind == "avg":
                second.append(F.sum(f"ownn{i}").alias(f"ownn{i}"))
            continue
        c, s, q = (F.col(f"{x}{i}") for x in "csq")
        if a.kind == "count":
            v = m * (c / n) * (1 - c / n)
        else:
            v = m * (q / n - (s / n) * (s / n))
        v = F.when(F.isnan(v) | (v < 0), F.lit(0.0)).otherwise(F.coalesce(v, F.lit(0.0)))
        second += [F.sum(c * w).alias(f"w{i}"), F.sum(s * w).alias(f"x{i}"), F.sum(v).alias(f"v{i}"), F.sum(c).alias(f"k{i}")]
    groups = strata.groupBy(*names).agg(*second)
    out = [F.col(x) for x in names]
    for i, a in enumerate(aggs):
        if a.plain or a.kind in ("min", "max"):
            e = F.col(f"own{i}") / F.col(f"ownn{i}") if a.kind == "avg" else F.col(f"own{i}")
            out += [e.alias(a.alias), *[x.alias(errors.column(f, a.alias)) for f, x in errors.exact().items()]]
            continue
        w_, x, v, k = (F.col(f"{y}{i}") for y in "wxvk")
        some = F.coalesce(k, F.lit(0)) > 0
        if a.kind == "count":
            e, d = F.coalesce(w_, F.lit(0.0)), F.sqrt(v)
        elif a.kind == "sum":
            e, d = F.when(some, x), F.sqrt(v)
        else:
            e, d = F.when(some, x / w_), F.sqrt(v / (w_ * w_))
        bound = F.when(some, d * factor(k, confidence))
        out += [e.alias(a.alias), *[c.alias(errors.column(f, a.alias)) for f, c in errors.from_bound(e, bound).items()]]
    return _named(groups.select(*out), by, names)


def _named(groups: DataFrame, by: dict[str, Column], names: list[str]) -> DataFrame:
    return groups.withColumnsRenamed(dict(zip(names, by)))


#: Cumulative probabilities of Poisson(1): a uniform below the first gives 0, the next 1, …
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson(u: Column) -> Column:
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


def trial_uniform(row: Column, trial: Column) -> Column:
    """A uniform number for a row and trial, from the leading 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", row, trial).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def bootstrap(df: DataFrame, by: dict[str, Column], aggs: list[Agg], row: Column, confidence: float = 0.95, trials: int = 100, multiplicity=None) -> DataFrame:
    """Poisson bootstrap: trial 0 is the sample, in every other a row counts Poisson(1) times.

    row: text that identifies a row, from which its multiplicities follow. Each row is expanded
    to the trials and summed per group and trial before anything is shuffled; a group's sorted
    estimates give the interval.
    """
    names = [f"g{i}" for i in range(len(by))]
    trial, mult = F.col("trial"), F.col("mult")
    draw = multiplicity or (lambda r, j: F.when(j == 0, 1).otherwise(poisson(trial_uniform(r, j))))
    estimated = [(i, a) for i, a in enumerate(aggs) if not (a.plain or a.kind in ("min", "max"))]
    own = [(i, a) for i, a in enumerate(aggs) if a.plain or a.kind in ("min", "max")]
    values = [c.alias(n) for c, n in zip(by.values(), names)] + [a.value().alias(f"v{i}") for i, a in estimated] + [weight().alias("w"), row.alias("r")]
    values += [(F.expr(a.arg) if a.kind in ("min", "max") else a.value()).alias(f"o{i}") for i, a in own]
    rows = df.select(*values).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("mult", draw(F.col("r"), trial))
    sums = [F.max(F.when(mult > 0, 1).otherwise(0)).alias("there")]
    for i, _ in estimated:
        v = F.col(f"v{i}")
        sums += [F.sum(mult * F.col("w") * v).alias(f"x{i}"), F.sum(F.when(v.isNotNull(), mult * F.col("w"))).alias(f"n{i}")]
    for i, a in own:
        f = {"min": F.min, "max": F.max, "count": F.count, "sum": F.sum, "avg": F.avg}[a.kind]
        sums.append(f(F.when(trial == 0, F.col(f"o{i}"))).alias(f"o{i}"))
    each = rows.groupBy(*names, "trial").agg(*sums)
    gathered = []
    for i, a in estimated:
        e = {"sum": F.col(f"x{i}"), "count": F.coalesce(f"n{i}", F.lit(0.0)), "avg": F.col(f"x{i}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))}[a.kind]
        e = F.when(F.col("there") > 0, e)
        gathered += [F.max(F.when(trial == 0, e)).alias(f"e{i}"), F.array_sort(F.collect_list(e)).alias(f"all{i}")]
    gathered += [F.max(f"o{i}").alias(f"o{i}") for i, _ in own]
    groups = each.groupBy(*names).agg(*gathered)
    out = [F.col(x) for x in names]
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    for i, a in enumerate(aggs):
        if (i, a) in own:
            out += [F.col(f"o{i}").alias(a.alias), *[x.alias(errors.column(f, a.alias)) for f, x in errors.exact().items()]]
            continue
        n = F.size(f"all{i}")
        lb = F.get(F.col(f"all{i}"), F.floor(n * low).cast("int"))
        ub = F.get(F.col(f"all{i}"), (F.ceil(n * high) - 1).cast("int"))
        e = F.coalesce(f"e{i}", F.lit(0.0)) if a.kind == "count" else F.col(f"e{i}")
        out += [e.alias(a.alias), *[c.alias(errors.column(f, a.alias)) for f, c in errors.from_interval(e, lb, ub).items()]]
    return _named(groups.select(*out), by, names)
