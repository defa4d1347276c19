"""Stored layout of the relations: buckets for the joins, folders for the filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Bucket key of the large relations: the key they are joined on most.
BUCKET_KEYS = {
    "orders": "id",
    "order_items": "order_id",
}
# Folder columns that listings and jobs filter on.
FOLDERS = {
    "orders": ["status"],
    "outbox": ["published"],
}


def save_bucketed(df: DataFrame, relation: str, table: str, buckets: int, path: str | None = None) -> None:
    """Store a relation in sorted buckets, so that joining two of them needs no shuffle.

    Relations to be joined must have the same number of buckets.
    """
    key = BUCKET_KEYS[relation]
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def load_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def save_in_folders(df: DataFrame, relation: str, path: str) -> None:
    """Store a relation by the columns its queries filter on, e.g. unpublished events."""
    df.write.mode("overwrite").partitionBy(*FOLDERS[relation]).parquet(path)
