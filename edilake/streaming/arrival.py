"""Arriving files, incrementally: a Structured Streaming file source feeding the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as claim_ops
from ..operators import coverage as coverage_ops
from ..operators.events import journal_events
from ..plans import store as st
from ..sources import journal as jn
from ..sources import x12


def arrivals(spark: SparkSession, folder: str, kind: str, glob: str = "*.edi") -> DataFrame:
    """A stream of documents of one type that land in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return raw.select(x12.relative(F.col("path"), None).alias("source_file"), F.lit(kind).alias("source_transaction"), F.lit(0).alias("input_ordinal"), F.decode("content", "ISO-8859-1").alias("text"))


def touched(journal: DataFrame, fresh: DataFrame) -> DataFrame:
    """The journal's events of the drops' aggregates that fresh events speak of: what must be folded again."""
    own = claim_ops.claim_events(fresh).select("claim_key").distinct()
    claims = claim_ops.claim_events(journal).join(own, "claim_key", "left_semi").select("event_id")
    members = coverage_ops.member_events(fresh).select("member_key").distinct()
    covered = coverage_ops.member_events(journal).join(members, "member_key", "left_semi").select("event_id")
    return journal.join(claims.union(covered).distinct(), "event_id", "left_semi")


def process(store: st.Store, journal_path: str, docs: DataFrame, batch: int, run_id: str = "run") -> None:
    """One batch: its events join the journal once, the aggregates they touch are folded again.

    Events carry their batch as input_ordinal, so drops keep their order of
    arrival. A batch that is run again finds its events in the journal and
    gives the same tables: publishing is by key.
    """
    spark = docs.sparkSession
    numbered = docs.withColumn("input_ordinal", F.lit(int(batch)))
    fresh = journal_events(x12.parse(numbered), run_id=run_id)
    fresh = fresh.withColumn("arrival_date", F.lit(f"batch-{int(batch):09d}"))
    # The batch's own partition is overwritten, so running it again adds nothing.
    fresh.write.mode("overwrite").option("compression", "zstd").parquet(f"{journal_path}/arrival_date=batch-{int(batch):09d}")
    every = jn.read(spark, journal_path)
    now = every.where(F.col("arrival_date") == f"batch-{int(batch):09d}").drop("arrival_date")
    if now.isEmpty():
        return
    store.stitch(touched(every.drop("arrival_date"), now), run_id)


def run(spark: SparkSession, folder: str, kind: str, store_path: str, journal_path: str, checkpoint: str, run_id: str = "run"):
    """Takes all files that have arrived since the last call, then stops; returns the finished query."""
    store = st.Store(spark, store_path)
    query = arrivals(spark, folder, kind).writeStream.foreachBatch(lambda df, n: process(store, journal_path, df, n, run_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_claim_status(events: DataFrame) -> DataFrame:
    """A running fold for consumers that only follow status: updates of each claim's last status, as a stream."""
    p = F.col("payload")
    return events.where("event_type = 'RemittanceClaimPaymentObserved'").groupBy(F.coalesce(p["claim_id_token"], p["claim_id"]).alias("claim_key")).agg(F.max_by(p["claim_status_code"], F.struct("input_ordinal", "source_file", "seq")).alias("claim_status_code"))
