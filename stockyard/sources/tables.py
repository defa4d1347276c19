"""Typed scans of the eight relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.schemas import TABLES


def conform(df: DataFrame, relation: str) -> DataFrame:
    """Project and cast to the relation's schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[relation].fields])


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations stored as Parquet folders named after them."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def load_jdbc(
    spark: SparkSession, url: str, relation: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """One relation over JDBC, read in `partitions` ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=relation,
        partitionColumn=key,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
        **options,
    )
    return conform(reader.load(), relation)
