"""Intermediate tables that several steps of a job read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the session names none (as in tests), one beside
    the warehouse is used."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there: lineage ends here and a lost
    executor repeats only the reading."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lookthru-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
