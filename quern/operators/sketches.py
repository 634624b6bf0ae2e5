"""Count-min sketches as tables of cells, and approximate counts.

A sketch is a DataFrame (row, col, n): every key adds its count to one column in each of `depth`
rows. Cells are summed on the map side, sketches merge by union and sum, and an estimate is the
least of a key's cells: never below the true count, and above it by more than eps times the total
with probability 1 - confidence at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CmsParams:
    depth: int = 7
    width: int = 200

    @classmethod
    def of(cls, eps: float = 0.01, confidence: float = 0.95) -> CmsParams:
        """Depth and width for an error of eps times the total; the width is a power of two."""
        if not 0 < eps < 1 or not 0 < confidence < 1:
            raise ValueError("eps and confidence must lie between 0 and 1")
        return cls(math.ceil(math.log(1 / (1 - confidence))), 1 << (math.ceil(math.e / eps) - 1).bit_length())

    @property
    def eps(self) -> float:
        return math.e / self.width

    @property
    def confidence(self) -> float:
        return 1 - math.exp(-self.depth)


def cell(key: Column, row: Column, width: int) -> Column:
    """The column of a key in a row: 52 bits of a digest, by the width."""
    digest = F.md5(F.concat_ws("|", row, key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") % width


def _spread(keys: DataFrame, params: CmsParams) -> DataFrame:
    rows = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(params.depth - 1))))
    return rows.withColumn("col", cell(F.col("key"), F.col("row"), params.width))


def counted(df: DataFrame, key: str, frequency: str | None = None) -> DataFrame:
    """(key, n) of a table; counts must not be negative, and fractions are cut off."""
    n = F.sum(F.expr(frequency).cast("bigint")) if frequency else F.count("*")
    rows = df.withColumn("__n", F.expr(frequency).cast("bigint")) if frequency else df
    if frequency:
        rows = rows.withColumn("__n", F.when(F.col("__n") < 0, F.raise_error(F.lit("negative counts are not allowed"))).otherwise(F.col("__n")))
        n = F.sum("__n")
    return rows.groupBy(F.expr(key).alias("key")).agg(n.alias("n"))


def build(counts: DataFrame, params: CmsParams) -> DataFrame:
    """The sketch of (key, n). Keys are counted before, so each adds `depth` rows at most."""
    return _spread(counts, params).groupBy("row", "col").agg(F.sum("n").alias("n"))


def estimate(sketch: DataFrame, keys: DataFrame, params: CmsParams) -> DataFrame:
    """(key, estimate) for each distinct key of keys (key)."""
    spread = _spread(keys.select("key").distinct(), params).join(sketch, ["row", "col"], "left")
    return spread.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("estimate"))


def merge(first: tuple[DataFrame, CmsParams], *others: tuple[DataFrame, CmsParams]) -> DataFrame:
    """Cell by cell; sketches of other shapes do not merge."""
    whole = first[0]
    for sketch, params in others:
        if params != first[1]:
            raise ValueError(f"sketches of {params} and {first[1]} do not merge")
        whole = whole.unionByName(sketch)
    return whole.groupBy("row", "col").agg(F.sum("n").alias("n"))


def compress(sketch: DataFrame, params: CmsParams) -> tuple[DataFrame, CmsParams]:
    """Half the width: columns that are half a width apart are added."""
    if params.width & (params.width - 1) or params.width < 2:
        raise ValueError("only a width that is a power of two can be halved")
    half = CmsParams(params.depth, params.width // 2)
    return sketch.groupBy("row", (F.col("col") % half.width).alias("col")).agg(F.sum("n").alias("n")), half


def approximate(estimate: Column, total: Column, params: CmsParams) -> Column:
    """An approximate count: (lower_bound, estimate, max, confidence)."""
    low = F.greatest(F.floor(estimate - total * params.eps), F.lit(0))
    return F.struct(low.cast("bigint").alias("lower_bound"), estimate.cast("bigint").alias("estimate"), estimate.cast("bigint").alias("max"), F.lit(params.confidence).alias("confidence"))


def add(a: Column, b: Column) -> Column:
    """Sum of approximate counts of one confidence; of others null."""
    same = a["confidence"] == b["confidence"]
    return F.when(same, F.struct(*[(a[k] + b[k]).alias(k) for k in ("lower_bound", "estimate", "max")], a["confidence"].alias("confidence")))


def subtract(a: Column, b: Column) -> Column:
    """Difference of approximate counts of one confidence: the bounds cross over."""
    same = a["confidence"] == b["confidence"]
    parts = ((a["lower_bound"] - b["max"]).alias("lower_bound"), (a["estimate"] - b["estimate"]).alias("estimate"), (a["max"] - b["lower_bound"]).alias("max"))
    return F.when(same, F.struct(*parts, a["confidence"].alias("confidence")))
