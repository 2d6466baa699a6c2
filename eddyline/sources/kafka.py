"""Kafka topics as sources and sinks, over Spark's Kafka connector."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.operators.hop import instant
from eddyline.schema import Schema
from eddyline.sources.codecs import JsonDeserializer, JsonSerializer

KEY = "__key"
_MESSAGES = "key binary, value binary, topic string, timestamp timestamp"


def record(messages: DataFrame, topic: str, path: str, at: Column) -> None:
    """Appends encoded messages (value, and key if there is one), with their time, to a folder from which KafkaSource(recorded=path) replays the topic without a broker."""
    key = F.col("key") if "key" in messages.columns else F.lit(None).cast("binary")
    rows = messages.select(key.alias("key"), "value", F.lit(topic).alias("topic"), at.cast("timestamp").alias("timestamp"))
    rows.write.mode("append").parquet(path)


@dataclass
class KafkaSource:
    """A topic whose values follow the schema. seek() starts it at a time; partitions without later data start at their end."""

    topic: str
    bootstrap_servers: str
    schema: type[Schema]
    group_id: str | None = None
    value_deserializer: Any = None
    key_deserializer: Any = None
    batch_size: int = 1000
    timeout: float | None = None  # seconds an executor waits for a poll; else Spark's default
    consumer_config: dict[str, str] = field(default_factory=dict)
    time_notion: Any = None
    seek_timestamp: dt.datetime | None = None
    recorded: str | None = None  # a folder written by record(), read instead of the broker's topic
    fail_on_data_loss: bool = True  # whether offsets that the broker no longer holds end the query; else they are skipped

    def seek(self, at: dt.datetime) -> KafkaSource:
        self.seek_timestamp = at
        return self

    def options(self, streaming: bool = True) -> dict[str, str]:
        config = {k: v for k, v in self.consumer_config.items() if k != "auto.offset.reset"}
        found = {"subscribe": self.topic, "kafka.bootstrap.servers": self.bootstrap_servers, "failOnDataLoss": str(self.fail_on_data_loss).lower(), **{f"kafka.{k}": str(v) for k, v in config.items()}}
        if self.group_id:
            found["kafka.group.id"] = self.group_id
        if self.seek_timestamp is not None:
            at = self.seek_timestamp if self.seek_timestamp.tzinfo else self.seek_timestamp.replace(tzinfo=dt.UTC)
            found |= {"startingTimestamp": str(int(at.timestamp() * 1000)), "startingOffsetsByTimestampStrategy": "latest"}
        else:
            found["startingOffsets"] = self.consumer_config.get("auto.offset.reset", "earliest")
        if self.timeout is not None:
            found["kafkaConsumer.pollTimeoutMs"] = str(int(self.timeout * 1000))
        if streaming:
            found["maxOffsetsPerTrigger"] = str(self.batch_size)
        return found

    def decode(self, raw: DataFrame) -> DataFrame:
        """key, value -> the schema's columns, and __key where a key deserializer is set. Rows that cannot be decoded are dropped."""
        value = (self.value_deserializer or JsonDeserializer(self.schema)).column(F.col("value"), self.topic)
        columns = [value.alias("_value")]
        if self.key_deserializer is not None:
            columns.append(self.key_deserializer.column(F.col("key"), self.topic, is_key=True).alias(KEY))
        rows = raw.select(*columns).where("_value is not null")
        return rows.select("_value.*", *[c for c in rows.columns if c == KEY])

    def read(self, spark: SparkSession) -> DataFrame:
        if self.recorded:
            return self.decode(self._replayed(spark.read.schema(_MESSAGES).parquet(self.recorded)))
        return self.decode(spark.read.format("kafka").options(**self.options(streaming=False)).load())

    def read_stream(self, spark: SparkSession) -> DataFrame:
        if self.recorded:
            return self.decode(self._replayed(spark.readStream.schema(_MESSAGES).parquet(self.recorded)))
        return self.decode(spark.readStream.format("kafka").options(**self.options()).load())

    def _replayed(self, messages: DataFrame) -> DataFrame:
        """The topic's messages, from the time that was sought."""
        rows = messages.where(F.col("topic") == self.topic)
        return rows if self.seek_timestamp is None else rows.where(F.col("timestamp") >= instant(self.seek_timestamp, "timestamp"))


@dataclass
class KafkaSink:
    """Writes rows to a topic. A column __key becomes the message key where a key serializer is given, and is never part of the value."""

    topic: str
    bootstrap_servers: str
    value_serializer: Any = None
    key_serializer: Any = None
    producer_config: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        return {"topic": self.topic, "kafka.bootstrap.servers": self.bootstrap_servers, **{f"kafka.{k}": str(v) for k, v in self.producer_config.items()}}

    def encode(self, df: DataFrame) -> DataFrame:
        body = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != KEY])
        columns = [(self.value_serializer or JsonSerializer()).column(body, self.topic).alias("value")]
        if self.key_serializer is not None and KEY in df.columns:
            columns.append(F.when(F.col(KEY).isNotNull(), self.key_serializer.column(F.col(KEY), self.topic, is_key=True)).alias("key"))
        return df.select(*columns)

    def write(self, df: DataFrame) -> None:
        self.encode(df).write.format("kafka").options(**self.options()).save()


@dataclass
class FanOutSink:
    """Writes each emission to several sinks."""

    sinks: list[Any]

    def write(self, df: DataFrame) -> None:
        df.persist()
        for sink in self.sinks:
            sink.write(df)
        df.unpersist()


class ConsoleSink:
    """Prints each emission as JSON lines."""

    def write(self, df: DataFrame) -> None:
        for row in df.toJSON().toLocalIterator():
            print(json.dumps(json.loads(row)))
