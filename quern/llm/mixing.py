"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens (words) raised to an exponent in [0, 1] and
normalised. The exponent is bisected: the largest at which the weights' entropy reaches the
target, then, if some source would be repeated beyond the limit, the smallest above it that
keeps the limit. Twenty halvings fix it to a millionth.

The weights are realised against a token budget. Each source's documents have a keyed random
order, in blocks: 256 blocks of 256 sub-blocks by the leading bytes of a keyed hash. A source
gets as many whole passes as its quota holds; the rest is the longest prefix of the permutation
that fits. Which block, sub-block and document end the prefix follows from running sums over
block totals, so no task sorts a source, however large.

`mixture` then lays out all uses of all sources as one permutation: every use of a document has a
keyed hash of its own, whose leading bytes name one of 65,536 blocks; blocks stay whole and their
rows are in order, so sources are mixed at every place and a document's uses stand apart.

A null source is a source of its own. Null and empty texts have no tokens; a source without any
gets weight zero and no copies. Ids may be of any type that has a text; a null id counts as the
empty text. Rows of one source and id stand or fall together. An empty table gives an empty
result. The input's columns are carried in a struct, so their names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, documents, n_words, salted_join

#: Up to so many sources the plan, a row for each, is broadcast; beyond, it is joined.
FEW_SOURCES = 10_000
STEPS = 20
BLOCK, SUB = 1 << 24, 1 << 16  # sizes in a 32-bit hash


@dataclass(frozen=True)
class Target:
    """entropy: share of the largest possible, that of equal weights. epochs: budget in tokens
    over all tokens. max_repeats: a source's tokens used over its tokens. seed: of the order."""

    entropy: float = 0.95
    max_repeats: float = 4.0
    epochs: float = 1.0
    seed: str = "mix"


def _key(seed: str, doc_id: Column, use: Column | None = None) -> Column:
    """32 hex digits: an id's place in its source's order, or that of one of its uses in the mixture's."""
    parts = [F.lit(seed), *([use.cast("string")] if use is not None else []), F.coalesce(doc_id.cast("string"), F.lit(""))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _keyed(rows: DataFrame, source: str, text: str, doc_id: str, seed: str) -> DataFrame:
    """__row (the columns of rows), __source, __id, __key (the order), __h (its first 32 bits) and __n (tokens)."""
    made = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), F.col(source).alias("__source"), F.col(doc_id).alias("__id"), n_words(F.col(text)).alias("__n"))
    made = made.withColumn("__key", _key(seed, F.col("__id")))
    return made.withColumn("__h", F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"))


def exponent(totals: DataFrame, target: Target) -> float:
    """The bisected exponent for totals (source, tokens): on the driver for FEW_SOURCES sources or
    fewer, else by a Spark aggregate for each halving."""
    rows = totals.filter("tokens > 0")
    n, total = rows.agg(F.count("*"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    shares = sorted(r[0] for r in rows.select(share).collect()) if n <= FEW_SOURCES else None

    def at(t: float) -> tuple[float, float]:
        """Entropy over its largest value, and the largest repetition."""
        if shares is not None:
            ws = [x**t for x in shares]
            z, zl, most = sum(ws), sum(w * math.log(w) for w in ws), max(w / x for w, x in zip(ws, shares))
        else:
            w = F.pow(share, F.lit(t))
            z, zl, most = rows.agg(F.sum(w), F.sum(w * F.log(w)), F.max(w / share)).first()
        return (math.log(z) - zl / z) / math.log(n), most / z * target.epochs

    def bisect(low: float, high: float, keeps) -> tuple[float, float]:
        """keeps(low) != keeps(high); the two ends after STEPS halvings."""
        first = keeps(low)
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if keeps(middle) == first else (low, middle)
        return low, high

    even = lambda t: at(t)[0] >= target.entropy
    spare = lambda t: at(t)[1] <= target.max_repeats
    t = 1.0 if even(1.0) else bisect(0.0, 1.0, even)[0] if even(0.0) else 0.0
    if not spare(t):
        t = bisect(t, 1.0, spare)[1] if spare(1.0) else 1.0
    return t


def plan(docs: DataFrame, scratch: Scratch, target: Target = Target(), source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per source: __of, passes, and cut, the key of the last document of the prefix."""
    rows = scratch.write(_keyed(docs, source, text, doc_id, target.seed).select("__source", "__key", "__h", "__n"))
    blocks = scratch.write(rows.groupBy("__source", (F.col("__h") / BLOCK).cast("int").alias("block")).agg(F.sum("__n").alias("tokens")))
    totals = scratch.write(blocks.groupBy("__source").agg(F.sum("tokens").alias("tokens")))
    t = exponent(totals, target)
    some = totals.filter("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0] or 1
    z = some.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(t)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(t)) / F.lit(z)).otherwise(0.0)
    quota = F.floor(F.round(weight * F.lit(float(total) * target.epochs), 3))
    quotas = totals.withColumn("weight", weight).withColumn("quota", quota)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0)
    quotas = scratch.write(quotas.withColumn("passes", passes.cast("long")).select("__source", "passes", (F.col("quota") - F.col("tokens") * passes).cast("long").alias("rest")))

    def last_block(sums: DataFrame, order: str) -> DataFrame:
        """Of each source the first part, in order, whose running sum passes `rest`; `rest` is what is left before it."""
        upto = F.sum("tokens").over(Window.partitionBy("__source").orderBy(order))
        ran = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        first = ran.groupBy("__source").agg(F.min_by(F.struct(order, (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest")), F.col(order)).alias("f"))
        return first.select("__source", f"f.{order}", "f.rest")

    one = scratch.write(last_block(_on_source(blocks, quotas.select("__source", "rest")), "block"))
    inside = _on_source(rows, one).filter((F.col("__h") / BLOCK).cast("int") == F.col("block"))
    inside = scratch.write(inside.withColumn("sub", (F.col("__h") / SUB).cast("int")).select("__source", "__key", "__n", "sub"))
    subs = inside.groupBy("__source", "sub").agg(F.sum("__n").alias("tokens"))
    two = scratch.write(last_block(_on_source(subs, one.select("__source", "rest")), "sub"))
    tail = _on_source(inside.withColumnRenamed("sub", "at"), two).filter("at = sub")
    ties = tail.groupBy("__source", "__key", "rest").agg(F.sum("__n").alias("n"))
    ran = ties.withColumn("upto", F.sum("n").over(Window.partitionBy("__source").orderBy("__key"))).filter("upto <= rest")
    within = ran.groupBy("__source").agg(F.max("__key").alias("cut"))
    # Without a document of the last sub-block, the prefix ends where that sub-block begins.
    edge = F.lower(F.lpad(F.hex("sub"), 4, "0"))
    cuts = _on_source(two, within, "left").select("__source", F.coalesce("cut", edge).alias("cut"))
    # A source without a last block has rest = 0 exactly when nothing is left to add.
    return scratch.write(_on_source(quotas, cuts, "left").select(F.col("__source").alias("__of"), "passes", "cut"))


def _on_source(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    return salted_join(rows, few, ["__source"], how)


def with_copies(docs: DataFrame, target: Target = Target(), source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """__row (the columns of docs), __id, __key, __h, __n and __copies, the number of times the mixture uses the row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    made = plan(docs, scratch, target, source, text, doc_id)
    rows = _keyed(docs, source, text, doc_id, target.seed)
    if made.count() <= FEW_SOURCES:
        joined = rows.join(F.broadcast(made), F.col("__source").eqNullSafe(F.col("__of")))
    else:
        joined = salted_join(rows, made.withColumnRenamed("__of", "__source"), ["__source"], "inner")
    inside = F.coalesce(F.col("__key") <= F.col("cut"), F.lit(False))
    return joined.select("__row", "__id", "__key", "__h", "__n", (F.col("passes") + inside.cast("long")).alias("__copies"))


def mixture(docs: DataFrame, target: Target = Target(), source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mixture uses it, with the columns of docs, in the
    order of the mixture's block permutation."""
    rows = with_copies(docs, target, source, text, doc_id).filter("__copies > 0")
    uses = rows.select("__row", "__id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__use"))
    uses = uses.withColumn("__place", _key(target.seed, F.col("__id"), F.col("__use"))).withColumn("__block", F.substring("__place", 1, 4))
    return uses.repartition("__block").sortWithinPartitions("__block", "__place").select("__row.*")


def op5_mixing(spark, sf_dir):
    rows = with_copies(documents(spark, sf_dir))
    place = _key(Target().seed, F.col("__id"), F.lit(1))
    return rows.select("__row.doc_id", "__row.source", F.col("__n").alias("n_tokens"), (F.col("__h") / BLOCK).cast("int").alias("block"), F.col("__copies").alias("copies"), F.when(F.col("__copies") > 0, F.substring(place, 1, 4)).alias("first_use_block"))
