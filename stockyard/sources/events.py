"""Decoding of JSON event bodies, from tables and from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_events(events: DataFrame, body: T.StructType, column: str = "payload") -> DataFrame:
    """Add `body` (a struct) and `malformed`.

    A body may also be a JSON string that holds the object's text; that layer is
    taken off first. Undecodable bodies are flagged, not retried.
    """
    raw = F.col(column)
    inner = F.when(
        F.trim(raw).startswith('"'), F.get_json_object(F.concat(F.lit("["), raw, F.lit("]")), "$[0]")
    ).otherwise(raw)
    schema = T.StructType([*body.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(inner, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return (
        events.withColumn("_b", parsed)
        .withColumn("malformed", F.col("_b").isNull() | F.col("_b._corrupt").isNotNull())
        .withColumn("body", F.when(~F.col("malformed"), F.struct(*[F.col(f"_b.{f.name}") for f in body.fields])))
        .drop("_b")
    )


def decoded(events: DataFrame) -> DataFrame:
    return events.filter("NOT malformed").drop("malformed")


def quarantined(events: DataFrame) -> DataFrame:
    """Bodies that could not be decoded, to be stored aside."""
    return events.filter("malformed").drop("malformed", "body")


def event_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 1
) -> DataFrame:
    """Files of events in arrival order, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
