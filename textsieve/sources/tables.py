"""Reading tables and bulk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, for work that costs more than moving them: a compact file is read by few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def load_csv(spark: SparkSession, path: str, key: str = "id", text: str = "body", header: bool = False, sep: str = ",") -> DataFrame:
    """A key and a text column of CSV files; no types are guessed, and rows that don't fit are an error."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(text, T.StringType())])
    return spark.read.csv(path, schema=schema, header=header, sep=sep, mode="FAILFAST", multiLine=True, escape='"')
