"""Secret scans with corpus-wide ownership frequency, in column expressions alone.

Base spans (assignments of 8 characters or more to a telling name, access keys, long hex runs)
stand as found. The method looks at where else in the corpus a candidate occurs: hashes of all
candidates are aggregated by distinct repositories and owners, first within each owner, so that
a value copied everywhere shrinks before the shuffle. A value of OWNERS owners or fewer is live,
any other a copied example. Mixed tokens (upper and lower case letters and digits, 20 characters
or more, outside base spans) are added as spans of kind `mixed` where they are live.

Verdicts join back over salted keys. Tables hold hashes of values, never the values.

Null and empty texts have no spans; a null owner or repository counts as one of its own. Rows
with one id, and repeated rows, are reported each. An empty table gives an empty result. Columns
beside the ones named cannot clash, since none is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, documents, let, salted_join
from ._spans import any_case, spans

#: The base patterns, in the order in which kinds are listed. A run of 16, 32 or
#: more characters at its leftmost start is the whole run, so the length is part of the pattern.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(any_case(n) for n in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
MIXED = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
ASSIGN_LEAST = 8

#: A value of more owners is an example that was copied.
OWNERS = 2


def _of_kind(found: Column, kind: int, value: str) -> Column:
    made = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.sha2(x[value].cast("binary"), 256).alias("hash")))
    return F.coalesce(made, F.array().cast("array<struct<start:int,kind:int,end:int,hash:string>>"))


def candidates(text: Column) -> Column:
    """Spans of all kinds of a text by start, then kind: (start, kind, end, hash of the value)."""
    assign = F.filter(spans(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= ASSIGN_LEAST)
    base = F.concat(_of_kind(assign, 0, "part"), _of_kind(spans(text, ACCESS), 1, "found"), _of_kind(spans(text, HEX), 2, "found"))
    mixed = F.filter(spans(text, MIXED), lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Z]") & x["found"].rlike("[a-z]"))
    digits = F.when(text.rlike("[0-9]"), mixed)

    def whole(b: Column) -> Column:
        free = F.filter(_of_kind(digits, 3, "found"), lambda m: ~F.exists(b, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"])))
        return F.sort_array(F.concat(b, free))

    return let(base, whole)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), owners: int = OWNERS) -> DataFrame:
    """doc_id and found, an array of (start, kind, end, live, n_repositories, n_owners), for each row.

    Base spans are all there; of kind `mixed` only live ones are.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    whole = F.coalesce(F.col(text), F.lit(""))
    place = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(repository)]), {"ignoreNullFields": "false"})
    rows = docs.select(F.col(doc_id).alias("doc_id"), candidates(whole).alias("c"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), place.alias("place"))
    rows = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()))
    each = rows.filter(F.size("c") > 0).select("rid", "owner", "place", F.explode("c").alias("x")).select("rid", "owner", "place", "x.*")
    places = each.groupBy("hash", "owner", "place").agg(F.count("*").alias("n"))
    by_owner = places.groupBy("hash", "owner").agg(F.count("*").alias("n_places"))
    freq = by_owner.groupBy("hash").agg(F.sum("n_places").alias("n_repositories"), F.count("*").alias("n_owners"))
    marked = salted_join(each.select("rid", "start", "kind", "end", "hash"), freq, ["hash"], "inner").withColumn("live", F.col("n_owners") <= owners)
    kept = marked.filter((F.col("kind") < 3) | F.col("live"))
    found = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "n_repositories", "n_owners"))).alias("found"))
    joined = rows.select("rid", "doc_id").join(found.hint("merge"), "rid", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,n_repositories:bigint,n_owners:bigint>>")
    return joined.select("doc_id", F.coalesce("found", none).alias("found"))


def op6_secrets(spark, sf_dir):
    found = F.col("found")
    of = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(found, lambda x: x["kind"] < 3)
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(found).alias("spans"),
        F.size(F.filter(found, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(found, lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )
