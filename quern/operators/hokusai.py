"""Decaying sketches of slots of time: the state of a top-K table whose counts must not grow with its keys.

The state is a table of cells (level, block, row, col, n). Cells of level -1 are slots as they
came in, at full width, not yet folded. `folded` adds them to

* level 0, one sketch for each slot, whose width is halved each time the slot's age doubles, down
  to FLOOR; and
* levels 1 and up, sums over aligned blocks of 2^level slots at full width. A block is kept while
  it holds a slot of an age below 2^(level + 1), so a few of each level stay; the block of the top level
  holds all slots there are.

Folding only adds, so late rows reach their slot and its blocks at any time. A range of slots is
read from whole blocks where these are kept; the rest is shared out of the block that holds it, in
proportion to what the narrow sketches of its slots say. Only a width that is a power of two above
FLOOR decays; at others every slot keeps its sketch, and ranges are sums of slots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketches
from .sketches import CmsParams

#: No sketch is halved below this width.
FLOOR = 512
CELLS = ("level", "block", "row", "col", "n")


def decays(params: CmsParams) -> bool:
    return params.width > FLOOR and not params.width & (params.width - 1)


def width_at(age: int, params: CmsParams) -> int:
    return max(FLOOR, params.width >> max(age.bit_length() - 1, 0)) if decays(params) else params.width


def _width(slot: Column, last: int, params: CmsParams) -> Column:
    """width_at as a column."""
    if not decays(params):
        return F.lit(params.width)
    doublings = F.length(F.bin(F.greatest(F.lit(last) - slot, F.lit(1)))) - 1
    return F.greatest(F.lit(FLOOR), F.call_function("shiftright", F.lit(params.width), doublings))


def top_level(last: int, params: CmsParams) -> int:
    """The level whose first block holds the slots 0 to last."""
    return last.bit_length() if decays(params) else 0


def kept(level: int, block: int, last: int, params: CmsParams) -> bool:
    """Whether the state has block of level at full width."""
    if level == 0:
        return width_at(max(last - block, 0), params) == params.width
    return level == top_level(last, params) or last - (((block + 1) << level) - 1) < 2 << level


def raw(counts: DataFrame, params: CmsParams) -> DataFrame:
    """Cells of level -1 from (slot, key, n)."""
    cells = sketches._spread(counts, params).groupBy("slot", "row", "col").agg(F.sum("n").alias("n"))
    return cells.select(F.lit(-1).alias("level"), F.col("slot").alias("block"), "row", "col", "n")


def folded(cells: DataFrame, params: CmsParams, last: int, top_before: int = 0) -> DataFrame:
    """The state at the time when `last` is the newest slot; top_before: the top level of what
    cells holds of an older state. That level's block holds all of its slots, so it starts the levels above."""
    top = top_level(last, params)
    level, from_ = F.col("level"), F.greatest("level", F.lit(0))
    reach = F.when(level < 0, F.sequence(F.lit(0), F.lit(top))).when(level == top_before, F.sequence(F.lit(top_before), F.lit(top))).otherwise(F.array(level))
    rows = cells.withColumn("to", F.explode(reach))
    rows = rows.select(F.col("to").alias("level"), F.call_function("shiftright", F.col("block"), F.col("to") - from_).alias("block"), "row", "col", "n")
    youngest = F.lit(last) - (F.call_function("shiftleft", F.col("block") + 1, level) - 1)
    rows = rows.filter((level == 0) | (level == top) | (youngest < F.call_function("shiftleft", F.lit(2).cast("bigint"), level)))
    narrowed = F.when(level == 0, F.col("col") % _width(F.col("block"), last, params)).otherwise(F.col("col"))
    return rows.withColumn("col", narrowed).groupBy("level", "block", "row", "col").agg(F.sum("n").alias("n"))


def slot_estimates(state: DataFrame, keys: DataFrame, params: CmsParams, last: int) -> DataFrame:
    """(slot, key, n) for each (slot, key) of keys, from the slot's own sketch."""
    spread = sketches._spread(keys.select("slot", "key"), params).withColumn("col", F.col("col") % _width(F.col("slot"), last, params))
    cells = state.filter("level = 0").select(F.col("block").alias("slot"), "row", "col", "n")
    return spread.join(cells, ["slot", "row", "col"], "left").groupBy("slot", "key").agg(F.min(F.coalesce("n", F.lit(0))).cast("bigint").alias("n"))


def largest(counts: DataFrame, size: int) -> DataFrame:
    """The `size` keys of largest n in each slot; ties by key. Tasks drop what cannot be among them first."""
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "key"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= size).drop("rank")


@dataclass(frozen=True)
class Part:
    """The slots lo to hi of a block that are wanted and not read as a whole."""

    level: int
    block: int
    lo: int
    hi: int

    @property
    def slots(self) -> range:
        return range(self.block << self.level, (self.block + 1) << self.level)


def pieces(first: int, end: int, last: int, params: CmsParams) -> tuple[list[tuple[int, int, int]], list[Part]]:
    """The slots first to end as whole blocks (level, first block, last block) and parts of blocks;
    their number grows with the logarithm of last. Blocks of parts do not overlap."""
    at, end, whole, parts = max(first, 0), min(end, last), [], []
    if not decays(params):
        return ([(0, at, end)] if at <= end else []), []
    while at <= end:
        fits = [j for j in range(top_level(last, params) + 1) if not at % (1 << j) and (at + (1 << j) - 1 <= end or end == last) and kept(j, at >> j, last, params)]
        if fits:
            whole.append((fits[-1], at >> fits[-1], at >> fits[-1]))
            at += 1 << fits[-1]
        else:
            level = (last - at).bit_length() - 1
            made = Part(level, at >> level, at, min(end, (((at >> level) + 1) << level) - 1))
            parts.append(made)
            at = made.hi + 1
    return whole, parts


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _numbered(parts: list[Part], condition) -> Column:
    """The number of the part whose condition holds, or null."""
    return F.coalesce(*[F.when(condition(p), F.lit(i)) for i, p in enumerate(parts)])


def estimates(state: DataFrame, keys: DataFrame, first: int, end: int, params: CmsParams, last: int) -> DataFrame:
    """(key, estimate) over the slots first to end, for each distinct key of keys (key)."""
    whole, parts = pieces(first, end, last, params)
    keys = keys.select("key").distinct()
    cells = state.filter(_any((F.col("level") == j) & F.col("block").between(a, b) for j, a, b in whole))
    made = sketches.estimate(cells.groupBy("row", "col").agg(F.sum("n").alias("n")), keys, params)
    if not parts:
        return made
    both = made.unionByName(_shared_out(state, keys, parts, params, last))
    return both.groupBy("key").agg(F.sum("estimate").cast("bigint").alias("estimate"))


def _shared_out(state: DataFrame, keys: DataFrame, parts: list[Part], params: CmsParams, last: int) -> DataFrame:
    """(key, estimate) for each key and part: the least over rows of a key's cell of the whole
    block, times what the wanted slots hold of it by their own sketches, by what all slots of the block hold.
    Where the own sketches alone give more than their error, they are taken as they are.
    """
    slot = F.col("block")
    narrow = state.filter("level = 0").withColumn("part", _numbered(parts, lambda p: slot.between(p.slots[0], p.slots[-1]))).filter("part IS NOT NULL")
    wanted = F.when(_any((F.col("part") == i) & slot.between(p.lo, p.hi) for i, p in enumerate(parts)), F.col("n")).otherwise(0)
    narrow = narrow.withColumn("width", _width(slot, last, params)).groupBy("part", "width", "row", F.col("col").alias("at")).agg(F.sum("n").alias("s"), F.sum(wanted).alias("a"))
    wide = state.withColumn("part", _numbered(parts, lambda p: (F.col("level") == p.level) & (slot == p.block))).filter("part IS NOT NULL").select("part", "row", "col", F.col("n").alias("m"))
    widths = sorted({(i, width_at(max(last - t, 0), params)) for i, p in enumerate(parts) for t in _turns(p, last)})
    pairs = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(w).alias("width")) for i, w in widths])
    spread = sketches._spread(keys, params).select("key", "row", "col", F.inline(pairs)).withColumn("at", F.col("col") % F.col("width"))
    by_row = spread.join(narrow, ["part", "width", "row", "at"], "left").groupBy("key", "part", "row", "col").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    by_row = by_row.join(wide, ["part", "row", "col"], "left")
    total = narrow.filter("row = 0").groupBy("part").agg(F.sum("a").alias("total"))
    least = F.min(F.coalesce(F.col("m") * F.col("a") / F.nullif(F.col("s"), F.lit(0)), F.lit(0.0)))
    found = by_row.groupBy("key", "part").agg(F.min("a").alias("own"), least.alias("shared")).join(total, "part", "left")
    narrowest = F.coalesce(*[F.when(F.col("part") == i, F.lit(min(w for j, w in widths if j == i))) for i in range(len(parts))])
    surely = F.col("own") > F.lit(math.e) * F.coalesce("total", F.lit(0)) / narrowest
    return found.select("key", F.when(surely, F.col("own")).otherwise(F.floor("shared")).cast("bigint").alias("estimate"))


def _turns(part: Part, last: int) -> set[int]:
    """Slots of a block that have, together, all the widths in it: its ends and those where an age is a power of two."""
    ages = {last - part.slots[0], last - part.slots[-1], *(1 << j for j in range(last.bit_length() + 1))}
    return {last - a for a in ages if last - a in part.slots}
