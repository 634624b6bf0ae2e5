"""Small tables that several jobs read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local
    session gets a temporary one; on a cluster it must be set, as executors have disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, and read from there. Names may repeat, and columns of
    no type are kept."""
    path = f"{shared_folder(df.sparkSession)}/quern-settled-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    untyped = [c for c, t in plain.dtypes if t == "void"]
    plain = plain.withColumns({c: F.lit(None).cast("string") for c in untyped})
    plain.write.parquet(path)
    back = df.sparkSession.read.schema(plain.schema).parquet(path)
    return back.withColumns({c: F.lit(None) for c in untyped}).toDF(*df.columns)
