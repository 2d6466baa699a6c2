"""Encoding of message values and keys as columns.

A serializer or deserializer is an object with column(value, topic, is_key) -> Column. Values that cannot be decoded become null and the row is dropped by the source.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.schema import Schema
from eddyline.sources import avro

_TO_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}  # to the microsecond
_MAGIC_BYTES = 5  # one zero byte and a four-byte schema id before each registered Avro value


@dataclass(frozen=True)
class JsonDeserializer:
    """A JSON object per the schema; time fields may be ISO-8601 strings."""

    schema: type[Schema]

    def column(self, value: Column, topic: str = "", is_key: bool = False) -> Column:
        wanted = self.schema.to_struct_type()
        lenient = T.StructType([T.StructField(f.name, f.dataType, True) for f in wanted])
        parsed = F.from_json(value.cast("string"), lenient, {"mode": "PERMISSIVE"})
        needed = [f.name for f in wanted if not f.nullable]
        valid = F.lit(True)
        for name in needed:
            valid = valid & parsed[name].isNotNull()
        return F.when(valid, parsed)


@dataclass(frozen=True)
class JsonSerializer:
    def column(self, value: Column, topic: str = "", is_key: bool = False) -> Column:
        return F.to_json(value, _TO_JSON).cast("binary")


@dataclass(frozen=True)
class AvroDeserializer:
    """Avro with a registry header. reader_schema: the JSON of the registered schema, or a callable (topic, 'key' or 'value') that fetches it from a registry."""

    reader_schema: str | Callable[[str, str], str]

    def column(self, value: Column, topic: str = "", is_key: bool = False) -> Column:
        schema = self.reader_schema if isinstance(self.reader_schema, str) else self.reader_schema(topic, "key" if is_key else "value")
        if not avro.in_spark():
            return avro.decoded(value, schema, _MAGIC_BYTES)
        from pyspark.sql.avro.functions import from_avro

        return from_avro(F.substring(value, _MAGIC_BYTES + 1, 2**31 - 1 - _MAGIC_BYTES), schema, {"mode": "PERMISSIVE"})


@dataclass(frozen=True)
class AvroSerializer:
    """Avro with a registry header. register: a callable (topic, 'key' or 'value', schema JSON) -> schema id."""

    schema: type[Schema]
    register: Callable[[str, str, str], int]

    def column(self, value: Column, topic: str = "", is_key: bool = False) -> Column:
        number = self.register(topic, "key" if is_key else "value", self.schema.to_avro_json())
        header = F.lit(bytearray(b"\x00" + number.to_bytes(4, "big")))
        if not avro.in_spark():
            return F.concat(header, avro.encoded(value, self.schema.to_avro_json()))
        from pyspark.sql.avro.functions import to_avro

        return F.concat(header, to_avro(value, self.schema.to_avro_json()))


@dataclass(frozen=True)
class CustomDeserializer:
    """Any function of (bytes, topic, is_key) to a dict; runs in Arrow batches, and what it fails on is dropped."""

    function: Callable[..., dict[str, Any]]
    schema: type[Schema]

    def column(self, value: Column, topic: str = "", is_key: bool = False) -> Column:
        function = self.function

        @F.pandas_udf("string")
        def decode(values: pd.Series) -> pd.Series:
            def one(raw: bytes | None) -> str | None:
                try:
                    return None if raw is None else json.dumps(function(bytes(raw), topic, is_key=is_key), default=str)
                except Exception:  # noqa: BLE001
                    return None

            return values.map(one)

        return JsonDeserializer(self.schema).column(decode(value))


@dataclass(frozen=True)
class CustomSerializer:
    """Any function of (dict, topic, is_key) to bytes."""

    function: Callable[..., bytes]

    def column(self, value: Column, topic: str = "", is_key: bool = False) -> Column:
        function = self.function

        @F.pandas_udf("binary")
        def encode(values: pd.Series) -> pd.Series:
            return values.map(lambda text: None if text is None else function(json.loads(text), topic, is_key=is_key))

        return encode(F.to_json(value, _TO_JSON))
