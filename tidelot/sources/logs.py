"""Kafka logs where the connector is installed, and logs kept as files of the same shape elsewhere."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "key binary, value binary, partition int, offset bigint, timestamp timestamp"


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # py4j wraps ClassNotFoundException
        return False


def _need_kafka(spark: SparkSession) -> None:
    if not kafka_available(spark):
        raise RuntimeError("the Kafka connector is not on the class path; read a file log with read_log or stream_log")


def read_topic(spark: SparkSession, servers: str, topic: str, start: dict[int, int] | str = "earliest", end: dict[int, int] | str = "latest") -> DataFrame:
    """A bounded read of all partitions; `start` and `end` by partition, or a name for all."""
    _need_kafka(spark)
    place = lambda x: x if isinstance(x, str) else json.dumps({topic: {str(p): o for p, o in x.items()}})
    r = spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": place(start), "endingOffsets": place(end)})
    return r.load().select("key", "value", "partition", "offset", "timestamp")


def stream_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    _need_kafka(spark)
    o = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), "kafka.isolation.level": "read_committed"}
    return spark.readStream.format("kafka").options(**o).load().select("key", "value", "partition", "offset", "timestamp")


def write_topic(df: DataFrame, servers: str, topic: str) -> None:
    """Append `key` and `value`; at least once, readers drop repeats."""
    _need_kafka(df.sparkSession)
    o = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.compression.type": "lz4"}
    df.select("key", "value").write.format("kafka").options(**o).save()


def read_log(spark: SparkSession, path: str, start: dict[int, int] | None = None, end: dict[int, int] | None = None) -> DataFrame:
    """A log kept as Parquet; bounds by partition are pushed to the scan, `end` is exclusive."""
    x = spark.read.schema(LOG_SCHEMA).parquet(path)
    for bounds, low in ((start, True), (end, False)):
        for p, o in (bounds or {}).items():
            c = F.col("offset") >= o if low else F.col("offset") < o
            x = x.filter((F.col("partition") != p) | c)
    return x


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def resume_offsets(states: DataFrame) -> DataFrame:
    """(`partition`, `resume`): where each partition goes on, the least of what its keys have applied."""
    return states.groupBy("partition").agg(F.min("resume_offset").alias("resume"))


def not_applied(log: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Rows at or after their key's `resume_offset`; keys without one take all."""
    x = log.join(states.select(key, "resume_offset"), key, "left")
    return x.filter(F.col("resume_offset").isNull() | (F.col("offset") >= F.col("resume_offset"))).drop("resume_offset")
