"""Queries of the incremental forms: a stream over a table's file is run to its end, and its result returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.operators.tables import ParquetTable
from marlinspike.plans.common import EVENTS, RAW, once
from marlinspike.plans.storage import SQL as STORAGE_SQL
from marlinspike.plans.storage import fact_changes
from marlinspike.session import scratch_folder, table
from marlinspike.streaming import intake

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return scratch_folder(spark, "stream")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # A stream reads folders: of a single file, its parent with a name filter.
    if fs.getFileStatus(folder).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("SELECT source_id, external_id, content_hash FROM raw_items GROUP BY ALL")
def ss1_raw_intake(spark: SparkSession, d: str) -> DataFrame:
    """SS1: raw versions taken in once each, the stream delivered twice."""
    at = _folder(spark)
    stored = ParquetTable(spark, f"{at}/raw")
    for run in ("a", "b"):
        intake.start(_stream(spark, d, "raw_items"), intake.raw_intake(stored), f"{at}/checkpoint-{run}").awaitTermination()
    return stored.read().select("source_id", "external_id", "content_hash")


@query("SELECT source_id, external_id, epoch_us(max(updated_at)) AS updated_us FROM opportunities GROUP BY source_id, external_id")
def ss2_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """SS2: the newest state of each posting after an upserting stream."""
    at = _folder(spark)
    stored = ParquetTable(spark, f"{at}/state")
    columns = ["source_id", "external_id", "status", "first_seen_at", "created_at", "updated_at"]
    intake.start(_stream(spark, d, "opportunities").select(*columns), intake.latest_state(stored), f"{at}/checkpoint").awaitTermination()
    return stored.read().select("source_id", "external_id", F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT user_id, count(*) AS n FROM behaviour_events GROUP BY user_id")
def ss3_journal(spark: SparkSession, d: str) -> DataFrame:
    """SS3: an appended journal keeps equal events."""
    at = _folder(spark)
    intake.journal(_stream(spark, d, "behaviour_events"), f"{at}/journal", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/journal").groupBy("user_id").agg(F.count("*").alias("n"))


@query(STORAGE_SQL["ag1_interest_counts"].replace(EVENTS, "behaviour_events"))
def ss4_running_interest(spark: SparkSession, d: str) -> DataFrame:
    """SS4: interest in total, by direction and by type of posting, as events come, every delivered event counted."""
    at = _folder(spark)
    kept = ParquetTable(spark, f"{at}/interest")
    o = once(spark, d, "opportunities").join(table(spark, d, "source_registry").select("source_id", "direction"), "source_id", "left").select("id", "direction", F.col("type").alias("profession"))
    stream = intake.running_interest(_stream(spark, d, "behaviour_events"), o)
    write = lambda batch, _: kept.replace(batch)
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return kept.read()


@query(STORAGE_SQL["sk6_fact_fold"])
def ss5_fact_fold(spark: SparkSession, d: str) -> DataFrame:
    """SS5: facts folded from a stream of changes, stated ones taking precedence; the stream delivered twice."""
    at = _folder(spark)
    kept = ParquetTable(spark, f"{at}/facts")
    for run in ("a", "b"):
        intake.start(fact_changes(_stream(spark, d, "behaviour_events")), intake.fact_fold(kept), f"{at}/checkpoint-{run}").awaitTermination()
    return kept.read().select("user_id", "field", "value", "source", F.unix_micros("stated_at").alias("stated_us"))


@query("SELECT user_id, action, count(*) AS n FROM behaviour_events GROUP BY user_id, action")
def ss4_running_counts(spark: SparkSession, d: str) -> DataFrame:
    """SS4: actions counted as they come, the last state of each count kept."""
    at = _folder(spark)
    stored = ParquetTable(spark, f"{at}/counts")
    write = lambda batch, _: stored.replace(batch)
    stream = intake.running_counts(_stream(spark, d, "behaviour_events"))
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stored.read()


@query(f"SELECT r.source_id, count(*) AS n FROM {RAW} r GROUP BY r.source_id")
def ss1_unique_within(spark: SparkSession, d: str) -> DataFrame:
    """SS1: raw items without repeats inside the watermark, counted by source."""
    at = _folder(spark)
    stream = intake.unique_within(_stream(spark, d, "raw_items").select("id", "source_id", "fetched_at"), ["id"], "fetched_at", "400 days")
    stream.writeStream.format("parquet").option("path", f"{at}/unique").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/unique").groupBy("source_id").agg(F.count("*").alias("n"))


