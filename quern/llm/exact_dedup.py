"""Exact dedup by distributed most-significant-byte-first radix partitioning.

All documents start in one group. Each round splits every open group by the next run of bytes
(64, then 16 times as many each round). A group with one document closes; documents that end
together within a group are equal; the rest go to the next round. Bytes themselves are the
keys, so equality rests on no digest. Only still open documents are read again.

Group sizes are pre-aggregated before the shuffle and joined back over salted keys, so a group
that holds a third of all rows spreads over many tasks.

Null text counts as empty; empty texts are equal to each other. Of equal texts the row with the
largest id stays (a null id is smallest); among repeated rows with that id one row stays. An
empty table gives an empty result. Columns of the input are carried in a struct, so their names
cannot clash with the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, documents, salted_join

FIRST_RUN = 64
RUN_GROWTH = 16
LONGEST_RUN = 1 << 22


def radix_groups(docs: DataFrame, doc_id: str, text: str, carry: list[Column], carries_text: bool = False) -> DataFrame:
    """doc_id, row (struct of carry), keep_id, group_size and kept, one row per row of docs.

    carries_text: the struct has the text, under its name, so it need not travel twice.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*carry).alias("row"), F.lit(0).cast("long").alias("gid"))
    live = body.drop("text") if carries_text else body
    whole = F.coalesce(F.col(f"row.`{text}`" if carries_text else "text"), F.lit("")).cast("binary")
    at, run, closed = 0, FIRST_RUN, []
    while True:
        keyed = live.withColumn("ended", F.octet_length(whole) <= at + run).withColumn("run", F.substring(whole, at + 1, run))
        keys = ["gid", "run", "ended"]
        shared = scratch.write(keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("next", F.monotonically_increasing_id()))
        split = salted_join(keyed, shared, keys, "left")
        state = F.when(F.col("next").isNull(), "single").when(F.col("ended"), "equal").otherwise("open")
        texts = [] if carries_text else [F.when(state == "open", F.col("text")).alias("text")]
        done = scratch.write(
            split.select("doc_id", "row", *texts, F.col("next").alias("gid"), state.alias("state"), F.monotonically_increasing_id().alias("rid"))
        )
        scratch.drop(shared)
        closed.append(done)
        live = done.filter("state = 'open'").drop("state", "rid")
        if live.isEmpty():
            break
        at, run = at + run, min(run * RUN_GROWTH, LONGEST_RUN)
    singles, equal = [], []
    for level, part in enumerate(closed):
        part = part.select("doc_id", "row", "state", F.struct(F.lit(level).alias("level"), "gid").alias("group"), "rid")
        singles.append(part.filter("state = 'single'"))
        equal.append(part.filter("state = 'equal'"))
    singles, equal = _union(singles), _union(equal)
    best = equal.groupBy("group").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("best"))
    kept = salted_join(equal, best, ["group"], "inner").select("doc_id", "row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"))
    alone = singles.select("doc_id", "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionAll(kept)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without copies: of equal texts the row with the largest id stays."""
    return radix_groups(docs, doc_id, text, [F.col(c) for c in docs.columns], carries_text=True).filter("kept").select("row.*")


def op9_exact_dedup(spark, sf_dir):
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    found = radix_groups(documents(spark, sf_dir), "doc_id", "text", [sha.alias("text_sha256")])
    return found.select("doc_id", "keep_id", "group_size", "kept", "row.text_sha256")
