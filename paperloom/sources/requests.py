"""Request topics. A topic is a Kafka topic, or a folder of JSON lines where the connector is not installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Micro-batch size and pace of the search worker.
REQUESTS_PER_BATCH = 8
BATCH_PACE = "200 milliseconds"
FILES_PER_BATCH = 64


def as_topic_rows(requests: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, value) rows: the whole request as JSON under its task id."""
    return requests.select(F.col(key).alias("key"), F.to_json(F.struct(*requests.columns)).alias("value"))


def decode(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).where("r IS NOT NULL").select("r.*")


def write_topic(requests: DataFrame, servers: str, topic: str, key: str = "task_id") -> None:
    as_topic_rows(requests, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_folder(requests: DataFrame, path: str, key: str = "task_id") -> None:
    as_topic_rows(requests, key).write.mode("append").json(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, schema: str, per_batch: int = REQUESTS_PER_BATCH) -> DataFrame:
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_batch)
        .load()
    )
    return decode(rows, schema)


def stream_folder(spark: SparkSession, path: str, schema: str, files: int = REQUESTS_PER_BATCH) -> DataFrame:
    """Oldest files first, a bounded number per batch."""
    rows = (
        spark.readStream.schema("key string, value string")
        .option("maxFilesPerTrigger", files)
        .option("latestFirst", False)
        .json(path)
    )
    return decode(rows, schema)


def request_events(requests: DataFrame, cancels: DataFrame) -> DataFrame:
    """The request and the cancel topic as one stream of (task_id, query_id, kind)."""
    side = lambda rows, kind: rows.select("task_id", "query_id", F.lit(kind).alias("kind"))
    return side(requests, "request").unionByName(side(cancels, "cancel"))


def stream_batches(spark: SparkSession, path: str, schema: str, files: int = FILES_PER_BATCH) -> DataFrame:
    """Parquet batches of a watched folder, oldest first."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(path)
    )
