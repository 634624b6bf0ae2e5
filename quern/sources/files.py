"""Readers for the formats that tests and scripts of approximate queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, kind: str | None = None, schema=None, **options) -> DataFrame:
    """Parquet, CSV with a header, or pipe-delimited text (`tbl`), by `kind` or the path's ending."""
    kind = kind or {"csv": "csv", "tbl": "tbl"}.get(path.rstrip("/").rpartition(".")[2].lower(), "parquet")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.options(header=True, inferSchema=schema is None).options(**options).csv(path)
    if kind == "tbl":
        return reader.options(sep="|").options(**options).csv(path)
    return reader.format(kind).load(path)
