"""Incremental forms: idempotent raw intake, latest state, journal and running interest counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlinspike.operators.gate import POSTING
from marlinspike.operators.profiles import current_facts
from marlinspike.operators.tables import ParquetTable, insert_new, upsert


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a step per micro-batch over what is there now; the checkpoint folder makes it resume."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def raw_intake(table: ParquetTable) -> Callable[[DataFrame, int], None]:
    """Appends raw versions not seen before; a repeated batch or item changes nothing."""
    keys = [*POSTING, "content_hash"]

    def step(batch: DataFrame, _: int) -> None:
        existing = table.read()
        new = insert_new(existing if existing is not None else batch.limit(0), batch, keys, order=["fetched_at"])
        table.append(new)

    return step


def latest_state(table: ParquetTable, keep: tuple[str, ...] = ("first_seen_at", "created_at")) -> Callable[[DataFrame, int], None]:
    """Upserts each batch's newest row per posting; the columns in keep survive."""

    def step(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(*POSTING).agg(F.max_by(F.struct(*batch.columns), "updated_at").alias("r")).select("r.*")
        existing = table.read()
        table.replace(newest if existing is None else upsert(existing, newest, POSTING, keep))

    return step


def unique_within(stream: DataFrame, keys: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """A stream without repeats of a key inside the watermark; state is kept for the delay only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def journal(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends events as they come; equal events are separate events and stay."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def running_counts(stream: DataFrame) -> DataFrame:
    """Events per user and action so far."""
    return stream.groupBy("user_id", "action").agg(F.count("*").alias("n"))


def running_interest(stream: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(user_id, dimension, key, action, n) so far, in total, by direction and by profession, events on missing postings under a null key.

    opportunities: id, direction, profession, one row per id; a static side, read anew by every batch.
    """
    joined = stream.join(opportunities.select(F.col("id").alias("opportunity_id"), "direction", "profession"), "opportunity_id", "left")
    none = F.lit(None).cast("string")
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), k.alias("key")) for d, k in (("total", none), ("direction", F.col("direction")), ("profession", F.col("profession")))])
    return joined.select("user_id", "action", F.explode(parts).alias("x")).groupBy("user_id", "x.dimension", "x.key", "action").agg(F.count("*").alias("n"))


def fact_fold(table: ParquetTable) -> Callable[[DataFrame, int], None]:
    """Folds each batch of changes (user_id, field, source, at, seq, value) into the facts that are held.

    What a person holds now is all that later changes need, so the state is the facts table itself. Changes of
    a later batch come after those of an earlier one, whatever their times. A batch that is run again changes
    nothing, as its changes lose against or equal what they made.
    """

    def step(batch: DataFrame, _: int) -> None:
        held = table.read()
        changes = batch.select("user_id", "field", "value", "source", "at", "seq", F.lit(1).alias("era"))
        if held is not None:
            changes = held.select("user_id", "field", "value", "source", F.col("stated_at").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("era")).unionByName(changes)
        table.replace(current_facts(changes, ("era", "at", "seq")))

    return step


def windowed_counts(stream: DataFrame, size: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events per day and action; rows later than the delay are dropped and their state freed."""
    return stream.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", size).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "action", "n")
