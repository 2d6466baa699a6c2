"""File and JDBC sources and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from eddyline.schema import Schema


@dataclass(frozen=True)
class FileSource:
    """Parquet, ORC, CSV, JSON or text files, read at once or as a stream with so many files per micro-batch."""

    path: str
    format: str = "parquet"
    schema: type[Schema] | None = None
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(self.schema.to_struct_type()) if self.schema else reader).load(self.path)

    def read_stream(self, spark: SparkSession, max_files: int = 1) -> DataFrame:
        schema = self.schema.to_struct_type() if self.schema else spark.read.format(self.format).options(**self.options).load(self.path).schema
        return spark.readStream.format(self.format).options(**self.options).option("maxFilesPerTrigger", max_files).schema(schema).load(self.path)


@dataclass(frozen=True)
class JdbcSource:
    url: str
    table: str
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(url=self.url, dbtable=self.table, **self.options).load()


@dataclass(frozen=True)
class FileSink:
    """Appends each emission to a folder, optionally partitioned."""

    path: str
    format: str = "parquet"
    partition_by: tuple[str, ...] = ()

    def write(self, df: DataFrame) -> None:
        df.write.mode("append").format(self.format).partitionBy(*self.partition_by).save(self.path)
