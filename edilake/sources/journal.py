"""The journal: event rows as a partitioned Parquet table with zstd pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "segment_id string, seq bigint, event_id string, event_type string, source_file string, source_transaction string, input_ordinal int, source_drop_id string, run_id string, "
    "source_segment_index bigint, source_byte_offset bigint, isa13 string, gs06 string, st02 string, payload map<string,string>, arrays map<string,array<string>>"
)


def write(events: DataFrame, path: str, append: bool = False, arrival_date: str | None = None, level: int = 1) -> None:
    """Writes a segment; without append an existing journal is an error. Levels are those of zstd."""
    if not 1 <= level <= 22:
        raise ValueError("the compression level is from 1 to 22")
    rows = events.withColumn("arrival_date", F.lit(arrival_date or "1970-01-01"))
    rows.write.mode("append" if append else "errorifexists").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).partitionBy("arrival_date").parquet(path)


def read(spark: SparkSession, path: str, arrival_date: str | None = None) -> DataFrame:
    """Reads a journal or the part that arrived on a date (partitions are pruned); an empty one is an error."""
    rows = spark.read.schema(f"{SCHEMA}, arrival_date string").parquet(path)
    if rows.limit(1).isEmpty():
        raise FileNotFoundError(f"no events in {path}")
    return rows if arrival_date is None else rows.where(F.col("arrival_date") == arrival_date)


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("segment_id", "seq")


def ndjson(events: DataFrame) -> DataFrame:
    """One JSON document an event: framing, control and payload (lists among its fields)."""
    control = F.struct("isa13", "gs06", "st02")
    fields = F.array_join(F.transform(F.map_entries("payload"), lambda x: F.concat(F.regexp_replace(F.regexp_replace(F.to_json(F.array(x["key"])), r"^\[", ""), r"\]$", ""), F.lit(":"), F.regexp_replace(F.regexp_replace(F.to_json(F.array(x["value"])), r"^\[", ""), r"\]$", ""))), ",")
    lists = F.array_join(F.transform(F.map_entries("arrays"), lambda x: F.concat(F.regexp_replace(F.regexp_replace(F.to_json(F.array(x["key"])), r"^\[", ""), r"\]$", ""), F.lit(":"), F.to_json(x["value"]))), ",")
    body = F.concat(F.lit("{"), F.concat_ws(",", F.when(fields != "", fields), F.when(lists != "", lists)), F.lit("}"))
    head = F.to_json(F.struct("event_type", "source_file", "source_transaction", "source_drop_id", "run_id", "source_segment_index", "source_byte_offset", control.alias("control")))
    return events.select("segment_id", "seq", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), body, F.lit("}")).alias("value"))
