"""Typed declaration of columns: class bodies that become Spark, DDL and Avro schemas."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Field:
    """A column; not null unless nullable. A default fills nulls at ingest."""

    spark_type: T.DataType
    avro_type: Any

    def __init__(self, *, nullable: bool = False, default: Any = None) -> None:
        self.nullable, self.default = nullable, default

    def to_spark(self) -> T.DataType:
        return self.spark_type

    def to_ddl(self) -> str:
        return self.to_spark().simpleString().upper()

    def avro(self, path: str) -> Any:
        return self.avro_type

    def to_avro(self, path: str = "Struct") -> Any:
        kind = self.avro(path)
        return ["null", kind] if self.nullable else kind


class String(Field):
    spark_type, avro_type = T.StringType(), "string"


class Int(Field):
    spark_type, avro_type = T.IntegerType(), "int"


class Long(Field):
    spark_type, avro_type = T.LongType(), "long"


class Float(Field):
    """A 64-bit number."""

    spark_type, avro_type = T.DoubleType(), "double"


class Bool(Field):
    spark_type, avro_type = T.BooleanType(), "boolean"


class Timestamp(Field):
    """An instant."""

    spark_type, avro_type = T.TimestampType(), {"type": "long", "logicalType": "timestamp-micros"}


class List(Field):
    def __init__(self, element: Field, **options: Any) -> None:
        super().__init__(**options)
        self.element = element

    def to_spark(self) -> T.DataType:
        return T.ArrayType(self.element.to_spark(), self.element.nullable)

    def avro(self, path: str) -> Any:
        return {"type": "array", "items": self.element.to_avro(path)}


class Struct(Field):
    def __init__(self, *, nullable: bool = False, default: Any = None, **fields: Field) -> None:
        super().__init__(nullable=nullable, default=default)
        self.fields = fields

    def to_spark(self) -> T.DataType:
        return T.StructType([T.StructField(n, f.to_spark(), f.nullable) for n, f in self.fields.items()])

    def avro(self, path: str) -> Any:
        return {"type": "record", "name": path, "fields": [{"name": n, "type": f.to_avro(f"{path}_{n}")} for n, f in self.fields.items()]}


class Schema:
    """Base of declared schemas; fields of base classes come first."""

    @classmethod
    def fields(cls) -> dict[str, Field]:
        return {name: f for base in reversed(cls.__mro__) for name, f in vars(base).items() if isinstance(f, Field)}

    @classmethod
    def to_struct_type(cls) -> T.StructType:
        return T.StructType([T.StructField(n, f.to_spark(), f.nullable) for n, f in cls.fields().items()])

    @classmethod
    def to_ddl(cls) -> str:
        return ", ".join(f"{n} {f.to_ddl()}{'' if f.nullable else ' NOT NULL'}" for n, f in cls.fields().items())

    @classmethod
    def to_avro(cls) -> dict[str, Any]:
        return {"type": "record", "name": cls.__name__, "fields": [{"name": n, "type": f.to_avro(f"{cls.__name__}_{n}")} for n, f in cls.fields().items()]}

    @classmethod
    def to_avro_json(cls) -> str:
        return json.dumps(cls.to_avro())

    @classmethod
    def conform(cls, df: DataFrame, check_nulls: bool = False) -> DataFrame:
        """The declared columns by name, cast and with defaults; missing ones are null. check_nulls fails the query at a null in a column that must not have one."""

        def column(name: str, field: Field) -> Column:
            value = (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(field.to_spark())
            if field.default is not None:
                value = F.coalesce(value, F.lit(field.default).cast(field.to_spark()))
            if check_nulls and not field.nullable:
                value = F.coalesce(value, F.raise_error(F.lit(f"null in column {name} of {cls.__name__}")).cast(field.to_spark()))
            return value.alias(name)

        return df.select(*[column(n, f) for n, f in cls.fields().items()])
