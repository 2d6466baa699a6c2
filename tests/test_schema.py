"""Schemas, time notions, connectors."""

import datetime as dt
import json

import pytest
from conftest import at
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline import Bool, EventTimeNotion, Float, Int, List, Long, ProcessingTimeNotion, Schema, String, Struct, Timestamp
from eddyline.sources.codecs import AvroSerializer, CustomDeserializer, CustomSerializer, JsonDeserializer, JsonSerializer
from eddyline.sources.kafka import KafkaSink, KafkaSource
from eddyline.sources.memory import BatchSource, FakeSource, as_data_source, frame


class Base(Schema):
    a = String()


class Everything(Base):
    b = Int(nullable=True)
    c = Long(default=7)
    d = Float()
    e = Bool()
    f = Timestamp()
    g = List(List(Float()))
    h = Struct(lat=Float(), tags=List(String(nullable=True)))
    i = List(Struct(x=Int()))


def test_types():
    fields = Everything.to_struct_type()
    assert fields.names == list("abcdefghi")
    assert fields["d"].dataType == T.DoubleType() and fields["b"].nullable and not fields["a"].nullable
    assert fields["g"].dataType == T.ArrayType(T.ArrayType(T.DoubleType(), False), False)
    assert Everything.to_ddl().startswith("a STRING NOT NULL, b INT, c BIGINT NOT NULL")


def test_avro():
    got = Everything.to_avro()
    kinds = {f["name"]: f["type"] for f in got["fields"]}
    assert got["name"] == "Everything" and kinds["b"] == ["null", "int"] and kinds["f"] == {"type": "long", "logicalType": "timestamp-micros"}
    assert kinds["h"]["name"] != kinds["i"]["items"]["name"]
    json.loads(Everything.to_avro_json())


def test_conform_by_name_with_defaults(spark):
    class S(Schema):
        a = String()
        c = Long(default=7)
        z = Int(nullable=True)

    rows = S.conform(spark.createDataFrame([(None, "x", "extra")], "c int, a string, w string")).collect()
    assert [tuple(r) for r in rows] == [("x", 7, None)]


class Small(Schema):
    id = String()
    timestamp = Timestamp()


def test_watermarks(spark):
    df = frame(spark, Small, [{"id": "a", "timestamp": at("10:00")}, {"id": "b", "timestamp": at("10:05")}, {"id": "c"}])
    assert EventTimeNotion("timestamp").watermark(df) == at("10:05")
    assert EventTimeNotion("timestamp", dt.timedelta(seconds=30)).watermark(df) == at("10:04:30")
    assert EventTimeNotion("timestamp").watermark(df.where("timestamp is null")) is None
    before = dt.datetime.now(dt.UTC)
    assert before <= ProcessingTimeNotion(dt.timedelta(hours=1)).watermark(df) + dt.timedelta(hours=1) <= dt.datetime.now(dt.UTC)


def test_kafka_options():
    source = KafkaSource("t", "host:1", Small, "g", consumer_config={"auto.offset.reset": "latest", "fetch.min.bytes": "5"})
    assert source.options()["startingOffsets"] == "latest" and source.options()["kafka.fetch.min.bytes"] == "5" and source.options()["maxOffsetsPerTrigger"] == "1000"
    moved = source.seek(at("10:00")).options()
    assert moved["startingTimestamp"] == str(int(at("10:00").timestamp() * 1000)) and "startingOffsets" not in moved
    assert KafkaSink("t", "host:1", producer_config={"acks": "all"}).options() == {"topic": "t", "kafka.bootstrap.servers": "host:1", "kafka.acks": "all"}


def test_kafka_decoding_skips_what_cannot_be_read(spark):
    raw = spark.createDataFrame(
        [(b'{"k": 1}', b'{"id": "good", "timestamp": "2024-01-01T10:00:00Z"}'), (None, b'{"id": "nokey", "timestamp": "2024-01-01T10:01:00Z"}'), (None, b"not json"), (None, b'{"timestamp": "2024-01-01T10:00:00Z"}'), (None, None)],
        "key binary, value binary",
    )

    class Key(Schema):
        k = Int()

    rows = KafkaSource("t", "h", Small, key_deserializer=JsonDeserializer(Key)).decode(raw).orderBy("id").collect()
    assert [(r["id"], r["__key"] and r["__key"]["k"]) for r in rows] == [("good", 1), ("nokey", None)]
    assert KafkaSource("t", "h", Small).decode(raw).columns == ["id", "timestamp"]
    own = KafkaSource("t", "h", Small, value_deserializer=CustomDeserializer(lambda raw, topic, is_key=False: json.loads(raw), Small)).decode(raw)
    assert sorted(r["id"] for r in own.collect()) == ["good", "nokey"]


def test_kafka_encoding(spark):
    df = spark.createDataFrame([("a", 1, "k1"), ("b", 2, None)], "id string, value int, __key string").withColumn("__key", F.when(F.col("__key").isNotNull(), F.struct(F.col("__key").alias("k"))))
    plain = KafkaSink("t", "h").encode(df)
    assert plain.columns == ["value"] and json.loads(plain.first()["value"]) == {"id": "a", "value": 1}
    keyed = KafkaSink("t", "h", key_serializer=JsonSerializer()).encode(df).collect()
    assert json.loads(keyed[0]["key"]) == {"k": "k1"} and keyed[1]["key"] is None
    own = KafkaSink("t", "h", value_serializer=CustomSerializer(lambda row, topic, is_key=False: f"custom:{row['id']}".encode())).encode(df)
    assert bytes(own.first()["value"]) == b"custom:a"
    assert KafkaSink("t", "h").encode(df.limit(0)).count() == 0


def test_avro_schemas_are_registered_by_topic_and_part(spark):
    calls = []
    serializer = AvroSerializer(Small, lambda *a: calls.append(a) or 3)
    serializer.column(F.struct("id"), "t")
    serializer.column(F.struct("id"), "t", is_key=True)
    assert [c[:2] for c in calls] == [("t", "value"), ("t", "key")] and json.loads(calls[0][2])["name"] == "Small"


def test_python_data_source(spark, tmp_path):
    rows = [[{"id": "a", "timestamp": at("10:00")}], [], [{"id": "b", "timestamp": at("10:01")}]]
    assert isinstance(FakeSource(rows), BatchSource)
    made = as_data_source("fake_rows", Small, lambda: FakeSource(rows))
    assert made.name() == "fake_rows" and made({}).schema() == "`id` string, `timestamp` timestamp"
    reader = made({}).simpleStreamReader(None)
    first, offset = reader.read(reader.initialOffset())
    assert [r[0] for r in first] == ["a"] and offset == {"batch": 1}
    assert [r[0] for r in reader.readBetweenOffsets({"batch": 0}, offset)] == ["a"]
