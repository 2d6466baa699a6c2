"""Codecs, recorded topics, tables in batches, and JDBC."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eddyline import Bool, Float, Int, List, Long, Schema, String, Struct, Timestamp
from eddyline.sources import avro, codecs, kafka
from eddyline.sources.files import JdbcSource
from eddyline.sources.memory import TableSource

AT = dt.datetime(2024, 1, 1, 10, 0, 0, 123456, dt.UTC)


class Wide(Schema):
    s = String()
    i = Int(nullable=True)
    n = Long()
    x = Float(nullable=True)
    b = Bool()
    t = Timestamp(nullable=True)
    tags = List(String())
    grid = List(List(Float()))
    at = Struct(lat=Float(), name=String(nullable=True))
    more = List(Struct(k=Int()), nullable=True)


ROWS = [
    ("ä漢😀", -1, 2**62, 0.1, True, AT, ["a", ""], [[1.0, -2.5], []], (1.5, None), [(1,), (-64,)]),
    ("", None, -(2**62), None, False, None, [], [], (float("inf"), "x"), None),
    ("x" * 300, 64, 0, -0.0, True, AT.replace(year=1950), ["z"] * 200, [[]], (1e-300, ""), []),
]


def test_avro_round_trip(spark):
    df = spark.createDataFrame(ROWS, Wide.to_struct_type())
    schema = Wide.to_avro_json()
    back = df.select(avro.decoded(avro.encoded(F.struct("*"), schema), schema).alias("v")).select("v.*")
    assert [r.asDict(recursive=True) for r in back.collect()] == [r.asDict(recursive=True) for r in df.collect()]


def test_avro_bytes():
    """The published examples of the encoding: zigzag numbers, lengths before text, union branches."""
    put = avro.writer(json.loads('["null", "string"]'))
    for value, wanted in ((None, b"\x00"), ("a", b"\x02\x02a")):
        out = bytearray()
        put(out, value)
        assert bytes(out) == wanted
    for n, wanted in ((0, "00"), (-1, "01"), (1, "02"), (-2, "03"), (2, "04"), (-64, "7f"), (64, "8001")):
        out = bytearray()
        avro.writer("long")(out, n)
        assert out.hex() == wanted
    out = bytearray()
    avro.writer({"type": "record", "name": "test", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]})(out, {"a": 27, "b": "foo"})
    assert out.hex() == "3606666f6f"


def test_avro_topic_drops_what_does_not_fit(spark):
    class One(Schema):
        k = Int()
        v = String(nullable=True)

    sink = kafka.KafkaSink("t", "", codecs.AvroSerializer(One, lambda topic, kind, schema: 258))
    encoded = sink.encode(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    assert {bytes(r["value"][:5]) for r in encoded.collect()} == {b"\x00\x00\x00\x01\x02"}
    bad = encoded.unionByName(encoded.select(F.expr("substring(value, 1, 6)").alias("value"))).unionByName(encoded.select(F.lit(None).cast("binary").alias("value")))
    source = kafka.KafkaSource("t", "", One, value_deserializer=codecs.AvroDeserializer(One.to_avro_json()))
    assert sorted((r["k"], r["v"]) for r in source.decode(bad.withColumn("key", F.lit(None).cast("binary"))).collect()) == [(1, "a"), (2, None)]


def test_json_keeps_microseconds_and_nulls(spark):
    class One(Schema):
        k = Int()
        t = Timestamp(nullable=True)

    df = spark.createDataFrame([(1, AT), (2, None)], One.to_struct_type())
    encoded = kafka.KafkaSink("t", "").encode(df).withColumn("key", F.lit(None).cast("binary"))
    assert json.loads(encoded.first()["value"].decode())["t"] == "2024-01-01T10:00:00.123456Z"
    assert sorted(kafka.KafkaSource("t", "", One).decode(encoded).collect()) == sorted(df.collect())


def test_lost_offsets_fail_unless_told_otherwise():
    source = lambda **more: kafka.KafkaSource("t", "b", Wide, **more).options()["failOnDataLoss"]
    assert kafka.KafkaSource("t", "b", Wide, timeout=1.5).options()["kafkaConsumer.pollTimeoutMs"] == "1500"
    assert source() == "true" and source(fail_on_data_loss=False) == "false"


def test_recorded_topic(spark, tmp_path):
    class One(Schema):
        k = Int()

    for k, at in ((1, AT), (2, AT + dt.timedelta(hours=1))):
        kafka.record(kafka.KafkaSink("t", "").encode(spark.createDataFrame([(k,)], "k int")), "t", str(tmp_path / "r"), F.lit(at))
    kafka.record(kafka.KafkaSink("u", "").encode(spark.createDataFrame([(3,)], "k int")), "u", str(tmp_path / "r"), F.lit(AT))
    source = kafka.KafkaSource("t", "", One, recorded=str(tmp_path / "r"))
    assert sorted(r["k"] for r in source.read(spark).collect()) == [1, 2]
    assert [r["k"] for r in source.seek(AT + dt.timedelta(minutes=1)).read(spark).collect()] == [2]


def test_table_source_gives_every_row_once(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 2), (4, 1)], "id int, part int").withColumn("t", F.timestamp_seconds(F.col("id") * 100))
    source = TableSource(df, F.col("part"), 4, "t")
    source.start()
    seen = []
    while (rows := source.read()) is not None:
        seen.append(sorted(r["id"] for r in rows.collect()))
    assert seen == [[1, 2], [4], [3], []]
    source.seek(dt.datetime(1970, 1, 1, 0, 5))
    source.start()
    assert [r["id"] for _ in range(3) for r in source.read().collect()] == [4, 3]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = JdbcSource(url, "t", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}).read(spark)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("kind", ["csv", "json", "orc"])
def test_files(spark, tmp_path, kind):
    from eddyline.sources.files import FileSource

    class One(Schema):
        k = Int()
        v = String(nullable=True)

    spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").write.format(kind).save(str(tmp_path / "f"))
    assert sorted(tuple(r) for r in FileSource(str(tmp_path / "f"), kind, One).read(spark).collect()) == [(1, "a"), (2, None)]
