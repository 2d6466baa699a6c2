"""Avro's binary encoding in Arrow batches, for sessions without Spark's Avro package.

Covers what schemas declare: string, int, long, double, boolean, microsecond instants, arrays, records and unions with null. Bytes that cannot be decoded give null.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import struct
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def in_spark() -> bool:
    """Whether the session has Spark's own Avro functions."""
    loader = SparkSession.active()._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    return loader.getResource("org/apache/spark/sql/avro/AvroDataToCatalyst.class") is not None


def spark_type(schema: Any) -> tuple[T.DataType, bool]:
    """The Spark type of a schema, and whether it may be null."""
    if isinstance(schema, list):
        return spark_type(next(s for s in schema if s != "null"))[0], True
    if isinstance(schema, str):
        return _SIMPLE[schema], False
    if schema["type"] == "record":
        return T.StructType([T.StructField(f["name"], *spark_type(f["type"])) for f in schema["fields"]]), False
    if schema["type"] == "array":
        return T.ArrayType(*spark_type(schema["items"])), False
    return (T.TimestampType() if schema.get("logicalType") == "timestamp-micros" else _SIMPLE[schema["type"]]), False


def _put_long(out: bytearray, n: int) -> None:
    """Zigzag, then seven bits a byte, low ones first."""
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _get_long(data: io.BytesIO) -> int:
    n = shift = 0
    while True:
        (byte,) = data.read(1)
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return (n >> 1) ^ -(n & 1)


def _micros(value: str) -> int:
    return (dt.datetime.fromisoformat(value) - _EPOCH) // dt.timedelta(microseconds=1)


def writer(schema: Any) -> Callable[[bytearray, Any], None]:
    """Appends a value to the bytes."""
    if isinstance(schema, list):
        null, other = schema.index("null"), next(i for i, s in enumerate(schema) if s != "null")
        inner = writer(schema[other])

        def put(out: bytearray, value: Any) -> None:
            _put_long(out, null if value is None else other)
            if value is not None:
                inner(out, value)

        return put
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "record":
        fields = [(f["name"], writer(f["type"])) for f in schema["fields"]]
        return lambda out, value: [w(out, value[n]) for n, w in fields] and None
    if kind == "array":
        item = writer(schema["items"])

        def put_all(out: bytearray, value: Any) -> None:
            if len(value):
                _put_long(out, len(value))
                for x in value:
                    item(out, x)
            out.append(0)

        return put_all
    if kind == "string":
        return lambda out, value: (_put_long(out, len(raw := value.encode())), out.extend(raw)) and None
    if kind == "double":
        return lambda out, value: out.extend(struct.pack("<d", float(value)))
    if kind == "boolean":
        return lambda out, value: out.append(bool(value))
    if not isinstance(schema, str) and schema.get("logicalType") == "timestamp-micros":
        return lambda out, value: _put_long(out, _micros(value))
    return lambda out, value: _put_long(out, int(value))


def reader(schema: Any) -> Callable[[io.BytesIO], Any]:
    """Takes a value from the bytes."""
    if isinstance(schema, list):
        kinds = [None if s == "null" else reader(s) for s in schema]
        return lambda data: (kind := kinds[_get_long(data)]) and kind(data)
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "record":
        fields = [(f["name"], reader(f["type"])) for f in schema["fields"]]
        return lambda data: {n: r(data) for n, r in fields}
    if kind == "array":
        item = reader(schema["items"])

        def get_all(data: io.BytesIO) -> list:
            out: list = []
            while n := _get_long(data):
                if n < 0:  # a block that also tells its size
                    n = -n
                    _get_long(data)
                out += [item(data) for _ in range(n)]
            return out

        return get_all
    if kind == "string":

        def get_text(data: io.BytesIO) -> str:
            raw = data.read(n := _get_long(data))
            if len(raw) != n:
                raise ValueError("the text ends early")
            return raw.decode()

        return get_text
    if kind == "double":
        return lambda data: struct.unpack("<d", data.read(8))[0]
    if kind == "boolean":
        return lambda data: data.read(1)[0] == 1
    if not isinstance(schema, str) and schema.get("logicalType") == "timestamp-micros":
        return lambda data: _EPOCH + dt.timedelta(microseconds=_get_long(data))
    return _get_long


@lru_cache(maxsize=64)
def _tools(schema: str) -> tuple[Callable, Callable]:
    parsed = json.loads(schema)
    return writer(parsed), reader(parsed)


def encoded(value: Column, schema: str) -> Column:
    """The struct column in Avro, by way of JSON; null where a value does not fit the schema."""

    @F.pandas_udf("binary")
    def encode(rows: pd.Series) -> pd.Series:
        put, _ = _tools(schema)

        def one(text: str | None) -> bytes | None:
            out = bytearray()
            try:
                put(out, json.loads(text))
            except (TypeError, ValueError, AttributeError, KeyError):
                return None
            return bytes(out)

        return rows.map(one)

    return encode(F.to_json(value, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}))


def decoded(value: Column, schema: str, skip: int = 0) -> Column:
    """The struct that the bytes behind the first ones encode, by way of JSON that the declared types are read from; null for bytes that do not."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        _, get = _tools(schema)

        def one(raw: bytes | None) -> str | None:
            if raw is None or len(raw) < skip:
                return None
            data = io.BytesIO(bytes(raw)[skip:])
            try:
                row = get(data)
                return None if data.read(1) else json.dumps(row, default=lambda t: t.isoformat(timespec="microseconds"))
            except (ValueError, IndexError, KeyError, struct.error, OverflowError):
                return None

        return rows.map(one)

    return F.from_json(decode(value), spark_type(json.loads(schema))[0])
