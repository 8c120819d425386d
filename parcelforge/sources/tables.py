"""Reading tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelforge.schemas import SCHEMAS


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table in Parquet, JSON, CSV or (with url, dbtable and partition options) a database, under its declared schema if it has one."""
    reader = spark.read.format(fmt).options(**options)
    if name in SCHEMAS and fmt != "jdbc":
        reader = reader.schema(SCHEMAS[name])
    return reader.load(path) if fmt != "jdbc" else reader.load()
