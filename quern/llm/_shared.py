"""What the operators of this subpackage share: scratch tables, salted joins, word arrays."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._tables import shared_folder

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Copies of the small side of a salted join; a key's rows spread over so many tasks.
SALTS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


class Scratch:
    """Parquet tables in the shared folder that spark.checkpoint.dir names.

    A written table cuts lineage: a lost executor costs only the tasks it ran. Where the session
    has no folder, a local one gets a temporary one, as in tests; a cluster must name one.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = shared_folder(spark)
        self.spark, self.path, self.n = spark, f"{root}/quern-{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        """df written and read from there. The shuffle files of the write go when it ends, where
        Spark would keep them until the driver collects garbage."""
        self.n += 1
        path, before = f"{self.path}/{self.n}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of tables that no later step reads."""
        for frame in frames:
            for name in {f.rpartition("/")[0] for f in frame.inputFiles()}:
                self._delete(name)

    def clear(self) -> None:
        """Delete all tables, once what reads them has been written."""
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str, salts: int = SALTS) -> DataFrame:
    """rows joined to few, which has a row for each key at most; null keys match null keys.

    A hot key's rows are dealt to `salts` tasks; each row of few is sent to all of them. The join
    merges at every size, so that a plan tried on little data is the plan for much.
    """
    rows = rows.withColumn("__salt", (F.monotonically_increasing_id() % salts).cast("int"))
    few = few.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    few = few.hint("merge").select(*[F.col(c).alias(f"__few_{c}") if c in (*keys, "__salt") else F.col(c) for c in few.columns])
    on = F.col("__salt") == F.col("__few___salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__few_{k}"))
    return rows.join(few, on, how).drop("__salt", "__few___salt", *[f"__few_{k}" for k in keys])


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a projection that Catalyst may not inline into a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.filter(F.split(plain, " ", -1), lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    """The number of words of a text; none for null."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +", -1))).cast("long")
