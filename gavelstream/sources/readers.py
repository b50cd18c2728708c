"""Batch and streaming readers of one kind of event, behind one interface.

Every reader takes the entity's declared schema. Streams carry TIMESTAMP event
times, as watermarks need them; tables may carry TIMESTAMP_NTZ.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelstream import schemas

#: How dates are written in JSON.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


@dataclass(frozen=True)
class Source:
    """Where one stream is: files of a format below a path, or a Kafka topic.

    options go to the reader as they are (for Kafka: kafka.bootstrap.servers,
    startingOffsets, maxOffsetsPerTrigger and so on). The group that a query
    reads as is its checkpoint, so queries don't share progress.
    """

    kind: str
    place: str
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return self._load(spark.read, schema)

    def stream(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return self._load(spark.readStream, schema)

    def _load(self, reader, schema: T.StructType) -> DataFrame:
        if self.kind == "kafka":
            options = {"startingOffsets": "earliest", "subscribe": self.place} | self.options
            return decode_json(reader.format("kafka").options(**options).load(), schema)
        if self.kind in ("json", "csv"):
            options = {"timestampFormat": TIME_FORMAT, "timestampNTZFormat": TIME_FORMAT} | self.options
            return reader.format(self.kind).options(**options).schema(schema).load(self.place)
        if self.kind == "raw":  # one column of JSON text, read as it is asked for
            return reader.format("text").options(**self.options).load(self.place).withColumnRenamed("value", "raw")
        return reader.format(self.kind).options(**self.options).schema(schema).load(self.place)


def decode_json(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns in the JSON of a message's value."""
    parsed = F.from_json(F.col("value").cast("string"), schema, {"timestampFormat": TIME_FORMAT})
    return messages.select(parsed.alias("_")).select("_.*")


def decode_keyed(messages: DataFrame, key_schema: T.StructType, schema: T.StructType) -> DataFrame:
    """Keyed messages (key, value, timestamp) as changes: the key's columns, those of the value, message_time, and deleted where a key comes without a value."""
    key = F.from_json(F.col("key").cast("string"), key_schema)
    value = F.from_json(F.col("value").cast("string"), schema, {"timestampFormat": TIME_FORMAT})
    rows = messages.select(key.alias("_key"), value.alias("_value"), F.col("timestamp").alias("message_time"), F.col("value").isNull().alias("deleted"))
    others = [F.col(f"_value.{f.name}").alias(f.name) for f in schema if f.name not in key_schema.names]
    return rows.select("_key.*", *others, "message_time", "deleted")


def from_raw(raw: DataFrame, schema: T.StructType, column: str = "raw") -> DataFrame:
    """A stream of JSON text with its fields taken out as schema says; a field that is missing is null."""
    parsed = F.from_json(F.col(column), schema, {"timestampFormat": TIME_FORMAT})
    return raw.select(parsed.alias("_")).select("_.*")


def with_declared_names(df: DataFrame, entity: str) -> DataFrame:
    """df with other producers' column names changed to the declared ones."""
    return df.withColumnsRenamed({k: v for k, v in schemas.OTHER_NAMES[entity].items() if k in df.columns})


def parse_time(column: str) -> Column:
    """A time that is written as text."""
    return F.to_timestamp(F.col(column), TIME_FORMAT)


def latest_by_key(changes: DataFrame, key: str, order: Column) -> DataFrame:
    """A change stream as a table: the last row of each key."""
    last = Window.partitionBy(key).orderBy(order.desc())
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def table_of_changes(changes: DataFrame, key: str) -> DataFrame:
    """decode_keyed's changes as a table: the last value of each key, without keys that were last deleted."""
    return latest_by_key(changes, key, F.col("message_time")).where("not deleted").drop("message_time", "deleted")


def literal_rows(spark: SparkSession) -> DataFrame:
    """The one row that shows that a source and a sink are connected."""
    return spark.createDataFrame([(1, "Hello streaming!")], "id int, message string")
