"""Stratified samples that are the same on every run.

Rows of a stratum are ordered by a keyed hash of all their columns and of their number among equal
rows, and the first k are taken: a simple random sample without replacement that any engine can
repeat. Strata are counted first (partial aggregation). Then rows are kept whose hash lies below
the stratum's k-th expected value plus six standard deviations, so that only about as many rows
as the sample has are shuffled, however large a stratum is. The number among equal rows is taken
where it matters: in strata of which copies pass (copies share the hash of their columns, so they
pass together), or of which too few rows pass. There copies are counted by partial aggregation,
and each is given a hash of its own; a hot row's copies are numbered in ranges, apart.

The k-th row is found from counts of PLACES ranges of hashes; ranges below it are taken whole, and
only the range that holds it is ranked, about k / PLACES rows of a stratum in one task.

A sample table has the columns of its base and five more: `quern_stratum` (the stratum's key as
text), `quern_taken` and `quern_total` (rows taken and rows there), `quern_row` (the row's hash,
which tells rows apart), and `quern_batch` (one insert each). Strata of different batches count
apart. A null stratum value is a stratum. Rows whose columns are arrays, maps or structs are told
apart by their JSON.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import LARGE, t, z
from ._tables import settle

STRATUM, TAKEN, TOTAL, ROW, BATCH = HIDDEN = ("quern_stratum", "quern_taken", "quern_total", "quern_row", "quern_batch")
#: What an aggregate needs of them.
CARRIED = HIDDEN[:4]
DEFAULT_RESERVOIR = 50


@dataclass(frozen=True)
class SampleOptions:
    """What `CREATE SAMPLE TABLE … OPTIONS` sets. qcs: columns or SQL expressions."""

    qcs: tuple[str, ...]
    fraction: float = 0.0
    reservoir: int = DEFAULT_RESERVOIR
    error_column: str | None = None
    error_percent: float = 0.0
    time_column: str | None = None
    time_interval: str | None = None
    bypass: bool = False
    seed: str = "quern"
    ignored: dict = field(default_factory=dict, compare=False)

    KNOWN = {
        "qcs": "qcs", "fraction": "fraction", "stratareservoirsize": "reservoir", "errorlimitcolumn": "error_column", "errorlimitpercent": "error_percent",
        "timeseriescolumn": "time_column", "timeinterval": "time_interval", "bypasssampleoperator": "bypass", "seed": "seed",
    }
    #: Storage options that have no meaning here.
    STORAGE = ("name", "basetable", "buckets", "redundancy", "partition_by", "eviction_by", "overflow", "concurrency")

    @classmethod
    def parse(cls, options: dict[str, str]) -> SampleOptions:
        made, ignored = {}, {}
        for key, value in options.items():
            k = key.lower()
            if k in cls.STORAGE:
                ignored[k] = value
            elif k not in cls.KNOWN:
                raise ValueError(f"unknown option of a sample table: {key}")
            else:
                made[cls.KNOWN[k]] = value
        if not str(made.get("qcs", "")).strip():
            raise ValueError("a sample table needs the option qcs")
        if isinstance(made["qcs"], str):
            made["qcs"] = tuple(split_list(made["qcs"]))
        for name, kind in (("fraction", float), ("reservoir", int), ("error_percent", float)):
            if name in made:
                made[name] = kind(made[name])
        if "bypass" in made:
            made["bypass"] = str(made["bypass"]).lower() == "true"
        if not 0 <= made.get("fraction", 0.0) <= 1:
            raise ValueError("fraction must lie between 0 and 1")
        if not 0 <= made.get("error_percent", 0.0) <= 100:
            raise ValueError("errorLimitPercent must lie between 0 and 100")
        if made.get("time_column") and not made.get("time_interval"):
            raise ValueError("timeSeriesColumn needs timeInterval")
        return cls(**made, ignored=ignored)


def split_list(text: str) -> list[str]:
    """Comma-separated items; commas inside parentheses do not separate."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [x for x in [*out, now.strip()] if x]


def canonical(name: str, kind: T.DataType) -> Column:
    """A column as text that engines agree on: cents for fractions of whole cents, a hash of the
    bits for others (NaN and infinity too), microseconds for times."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = c.cast("double")
        cents = F.round(x * 100)
        c = F.when((F.abs(x) < 1e13) & (cents / 100 == x), cents.try_cast("bigint").cast("string")).when(c.isNotNull(), F.concat(F.lit("x"), F.xxhash64(x)))
    elif isinstance(kind, T.DecimalType):
        cents = (c * 100).cast(T.DecimalType(38, 0)) if kind.scale <= 2 and kind.precision <= 34 else None
        c = cents.cast("string") if cents is not None else c.cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def row_hash(df: DataFrame, seed: str = "quern") -> Column:
    """32 hex digits: the order of rows within their stratum, for the first of equal rows."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[canonical(f.name, f.dataType) for f in df.schema.fields]).cast("binary"))


def copy_hash(hash_: Column, number: Column) -> Column:
    """The hash of the number-th of equal rows."""
    return F.when(number == 1, hash_).otherwise(F.md5(F.concat_ws("|", hash_, number.cast("string")).cast("binary")))


def uniform(hash_: Column) -> Column:
    """A number in [0, 1) from the leading 52 bits of a hex digest."""
    return F.conv(F.substring(hash_, 1, 13), 16, 10).cast("double") / float(1 << 52)


def stratum_key(qcs: tuple[str, ...], batch: int = 0) -> Column:
    return F.concat_ws("|", F.lit(batch), *[F.coalesce(F.expr(q).cast("string"), F.lit("\\N")) for q in qcs])


#: Up to so many strata their counts, a few dozen bytes each, are broadcast; beyond, they are joined.
FEW_STRATA = 100_000


#: Ranges of hashes that are counted to find a stratum's last row, and copies that are numbered together.
PLACES, RANGE = 1024, 1 << 20


def _bound() -> Column:
    """Hashes up to it hold the k least of a stratum, with six standard deviations to spare."""
    return F.least((F.col("quern_k") + 6 * F.sqrt("quern_k") + 30) / F.col(TOTAL), F.lit(1.0))


def _numbered(rows: DataFrame) -> DataFrame:
    """Each copy of the rows (with __h) with a hash of its own, where it is within the bound."""
    others = [c for c in rows.columns if c not in ("__h", "__n")]
    once = rows.groupBy(STRATUM, "__h").agg(F.count("*").alias("__n"), F.first(F.struct(*[F.col(f"`{c}`") for c in others if c != STRATUM])).alias("__row"))
    spans = once.withColumn("__span", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("__n") - 1) / RANGE).cast("long"))))
    spans = spans.repartition(F.col(STRATUM), F.col("__h"), F.col("__span"))
    number = F.explode(F.sequence(F.col("__span") * RANGE + 1, F.least((F.col("__span") + 1) * RANGE, F.col("__n"))))
    each = spans.withColumn("__i", number).withColumn("__h", copy_hash(F.col("__h"), F.col("__i")))
    return each.select(STRATUM, "__h", "__row.*").filter(uniform(F.col("__h")) <= _bound()).select(*rows.columns)


def _least(passed: DataFrame, joined) -> DataFrame:
    """The quern_k rows of least __h of each stratum."""
    place = F.least(F.floor(uniform(F.col("__h")) / _bound() * PLACES), F.lit(PLACES - 1)).cast("int")
    placed = passed.withColumn("__place", place)
    counts = placed.groupBy(STRATUM, "quern_k", "__place").agg(F.count("*").alias("__n"))
    upto = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(STRATUM).orderBy("__place")))
    last = upto.filter("__upto >= quern_k").groupBy(STRATUM).agg(F.min_by(F.struct(F.col("__place").alias("last"), (F.col("quern_k") - F.col("__upto") + F.col("__n")).alias("rest")), F.col("__place")).alias("__last"))
    placed = placed.join(joined(last), STRATUM, "left")
    ahead = placed.filter(F.col("__last").isNull() | (F.col("__place") < F.col("__last.last")))
    edge = placed.filter(F.col("__place") == F.col("__last.last"))
    edge = edge.withColumn("__r", F.row_number().over(Window.partitionBy(STRATUM).orderBy("__h"))).filter("__r <= __last.rest").drop("__r")
    return ahead.unionByName(edge).drop("__place", "__last")


def _bottom(df: DataFrame, counts: DataFrame, seed: str) -> DataFrame:
    """Of each stratum of counts (quern_stratum, quern_total, quern_k) the quern_k rows of least hash."""
    few = counts.count() <= FEW_STRATA
    joined = F.broadcast if few else (lambda t: t)
    marked = df.withColumn("__h", row_hash(df.drop(STRATUM), seed)).join(joined(counts), STRATUM)
    passed = settle(marked.filter(uniform(F.col("__h")) <= _bound()))
    met = passed.groupBy(STRATUM, "__h").agg(F.count("*").alias("__n")).groupBy(STRATUM).agg(F.sum("__n").alias("__n"), F.max("__n").alias("__most"))
    unsure = (F.col(TOTAL) > F.col("quern_k")) & ((F.coalesce("__n", F.lit(0)) < F.col("quern_k")) | (F.col("__most") > 1)) | (F.coalesce("__n", F.lit(0)) < F.least("quern_k", TOTAL))
    again = settle(counts.join(met, STRATUM, "left").filter(unsure).select(STRATUM))
    if not again.isEmpty():
        passed = settle(passed.join(joined(again), STRATUM, "left_anti").unionByName(_numbered(marked.join(joined(again), STRATUM, "left_semi"))))
    taken = _least(passed, joined)
    return taken.withColumn(TAKEN, F.least("quern_k", TOTAL)).withColumn(ROW, F.col("__h")).drop("__h", "quern_k")


def equal_allocation(counts: DataFrame, fraction: float, least: int) -> int:
    """The k at which the strata's min(rows, k) add up to fraction of all rows, `least` or more.

    Between two sizes of strata that follow each other the sum is linear in k, so one pass over
    the distinct sizes finds it.
    """
    sizes = counts.groupBy(F.col(TOTAL).alias("t")).agg(F.count("*").alias("n"))
    goal = round(fraction * (sizes.agg(F.sum(F.col("t") * F.col("n"))).first()[0] or 0))
    order = Window.orderBy("t")
    spans = sizes.unionByName(sizes.sparkSession.range(1).select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("n")))
    spans = spans.select("t", F.sum(F.col("t") * F.col("n")).over(order).alias("below"), F.sum("n").over(order).alias("smaller"), F.lead("t").over(order).alias("next"), F.sum("n").over(Window.partitionBy()).alias("strata"))
    reach = F.floor((F.lit(goal) - F.col("below")) / (F.col("strata") - F.col("smaller")))
    k = spans.filter("next IS NOT NULL").select(F.least(reach, F.col("next")).alias("k"), "t").filter("k >= t").agg(F.max("k")).first()[0]
    return max(least, int(k or 0))


def error_limited_size(total: Column, mean: Column, deviation: Column, percent: float) -> Column:
    """Rows of a stratum that keep its mean within percent at 95 %: finite-population Neyman size."""
    e = F.abs(mean) * percent / 100 / z(0.975)
    return F.ceil(total / (e * e / (F.nullif(deviation * deviation, F.lit(0.0)) / total) + 1))


def stratified_sample(df: DataFrame, options: SampleOptions, batch: int = 0) -> DataFrame:
    """The sample of df. An error-limited sample comes first, then a fraction, then a reservoir."""
    if options.bypass:
        return df
    keys = options.qcs
    if options.time_column:
        slot = F.date_trunc("microsecond", F.window(F.col(options.time_column), options.time_interval)["start"])
        df, keys = df.withColumn("__slot", slot), (*keys, "__slot")
    df = df.withColumn(STRATUM, stratum_key(keys, batch)).drop("__slot")
    if options.error_column and options.error_percent:
        x = F.col(options.error_column).cast("double")
        stats = df.groupBy(STRATUM).agg(F.count("*").alias(TOTAL), F.avg(x).alias("m"), F.stddev_pop(x).alias("d"))
        size = F.coalesce(error_limited_size(F.col(TOTAL), F.col("m"), F.col("d"), options.error_percent), F.lit(1))
        counts = settle(stats.select(STRATUM, TOTAL, F.least(F.greatest(size, F.lit(options.reservoir)), F.col(TOTAL)).cast("long").alias("quern_k")))
    else:
        counts = settle(df.groupBy(STRATUM).agg(F.count("*").alias(TOTAL)))
        if options.fraction > 0:
            k = equal_allocation(counts, options.fraction, options.reservoir)
        elif options.reservoir > 0:
            k = options.reservoir
        else:
            raise ValueError("a sample table needs a fraction, a reservoir size or an error limit")
        counts = counts.withColumn("quern_k", F.lit(k).cast("long"))
    return _bottom(df, counts, options.seed).withColumn(BATCH, F.lit(batch)).select(*[F.col(f"`{c}`") for c in df.columns if c != STRATUM], *HIDDEN)


def error_stats(sample: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Count, mean and variance of the sampled rows for groups within the strata."""
    x = F.col(column).cast("double")
    return sample.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))


def error_estimate_average(sample: DataFrame, column: str, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Mean, standard deviation, error of the mean, and that in percent, for each group."""
    p = 0.5 + confidence / 2
    small = F.array(*[F.lit(t(p, d)) for d in range(1, LARGE - 1)])
    q = F.when(F.col("n") >= LARGE, F.lit(z(p))).otherwise(F.element_at(small, F.least(F.greatest(F.col("n") - 1, F.lit(1)), F.lit(LARGE - 2)).cast("int")))
    s = error_stats(sample, column, by).withColumn("stdev", F.sqrt("variance"))
    s = s.withColumn("error_estimate", q * F.col("stdev") / F.sqrt("n"))
    return s.select(*by, "mean", "stdev", "error_estimate", (F.abs(F.col("error_estimate") * 100 / F.nullif(F.col("mean"), F.lit(0.0)))).alias("percent_error"))
