"""The engine's verbs: refetch, ingest, reprocess, coverage and evaluation over tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions.text import plain_spaces
from marlinspike.operators import evaluation, gate, reports
from marlinspike.operators.completion import CACHE, Client, refresh_cache
from marlinspike.operators.enrich import enrich, stored
from marlinspike.operators.model_client import PROMPT_VERSION
from marlinspike.operators.tables import ParquetTable, insert_new, upsert
from marlinspike.sources import feeds
from marlinspike.sources.registry import configs, reader_for

RAW = "id long, source_id string, external_id string, url string, fetched_at timestamp, payload string, content_type string, content_hash string, http_status int"
PLAIN = ("title", "description", "employer", "location_raw", "salary_raw", "posted_at")
DERIVED = ("profession", "direction", "country", "required_certificates", "required_languages", "preferred_languages", "experience_level", "workplace_type_hint")


#: The tables' versions in order: what each version creates. A version that a folder has is never run again.
MIGRATIONS = (
    ("0001_raw_items", {"raw_items": RAW}),
    ("0002_profiles", {"profiles": "user_id string, created_at timestamp, updated_at timestamp", "facts": "user_id string, field string, value struct<items:array<string>,confidence:double>, source string, stated_at timestamp"}),
    ("0003_journal", {"journal": "id long, user_id string, opportunity_id long, action string, dwell_seconds int, occurred_at timestamp"}),
    ("0004_model_answers", {"answers": CACHE}),
)


def upgrade(spark: SparkSession, folder: str) -> list[str]:
    """Brings a folder's tables to the newest version; the versions that were run now."""
    log = ParquetTable(spark, f"{folder}/versions")
    log.ensure("version string, applied_at timestamp")
    done = {r.version for r in log.read().collect()}
    new = [v for v, _ in MIGRATIONS if v not in done]
    for version, tables in MIGRATIONS:
        if version in new:
            for name, schema in tables.items():
                ParquetTable(spark, f"{folder}/{name}").ensure(schema)
            log.append(spark.createDataFrame([(version,)], "version string").withColumn("applied_at", F.current_timestamp()))
    return new


def ensure(spark: SparkSession, folder: str) -> None:
    """Creates the tables that don't exist."""
    upgrade(spark, folder)


def refetch(spark: SparkSession, folder: str, registry: DataFrame, source_id: str, path: str, limit: int | None = None, now: Column | None = None) -> int:
    """Stores the raw versions of a feed that aren't stored yet, and how many there were; fetched_at is `now`, the clock unless given."""
    ensure(spark, folder)
    table = ParquetTable(spark, f"{folder}/raw_items")
    items = reader_for(configs(registry), source_id)(spark, path, source_id)
    items = items.limit(limit) if limit is not None else items
    existing = table.read()
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    shaped = items.select(
        (F.lit(start) + 1 + F.monotonically_increasing_id()).alias("id"), "source_id", "external_id", "url", (now if now is not None else F.current_timestamp()).alias("fetched_at"), "payload", F.lit(None).cast("string").alias("content_type"), "content_hash", F.lit(200).alias("http_status")
    )
    new = insert_new(existing, shaped, ["source_id", "external_id", "content_hash"], order=["id"]).persist()
    count = new.count()
    table.append(new)
    new.unpersist()
    return count


def processed(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Latest versions, normalized, gated, classified and enriched: a lazy plan over all raw items, no network."""
    latest = gate.latest_versions(raw.dropDuplicates(["id"]))
    gated = gate.gate(feeds.normalize(latest), raw)
    classified = gated.withColumn("_c", gate.classification(F.col("declared_type"), F.col("title"))).withColumn("type", F.col("_c.type")).withColumn("type_confidence", F.col("_c.confidence")).drop("_c")
    trust = registry.select("source_id", F.col("trust").alias("source_trust")).dropDuplicates(["source_id"])
    return enrich(classified.join(trust, "source_id", "left"), registry)


def reprocess(spark: SparkSession, folder: str, registry: DataFrame, source_id: str | None = None, now: Column | None = None) -> int:
    """Runs the stages again over the latest stored versions and upserts the stored documents; the number of postings.

    created_at and first_seen_at are of a posting's first run and survive; updated_at is `now`, the clock unless given.
    """
    raw = ParquetTable(spark, f"{folder}/raw_items").read()
    if source_id is not None:
        raw = raw.where(F.col("source_id") == source_id)
    table = ParquetTable(spark, f"{folder}/opportunities")
    at = now if now is not None else F.current_timestamp()
    new = stored(processed(raw, registry)).withColumns({"first_seen_at": at, "created_at": at, "updated_at": at})
    existing = table.read()
    table.replace(new if existing is None else upsert(existing, new, gate.POSTING, keep=("first_seen_at", "created_at")))
    return table.read().count()


def ingest(spark: SparkSession, folder: str, registry: DataFrame, source_id: str, path: str, limit: int | None = None) -> tuple[int, int]:
    """refetch() and then reprocess() of one source: (fetched, processed)."""
    return refetch(spark, folder, registry, source_id, path, limit), reprocess(spark, folder, registry, source_id)


def coverage(spark: SparkSession, folder: str, source_id: str) -> DataFrame:
    """Fill rates of one source, derived fields read from the stored document; a source without data is an error."""
    rows = ParquetTable(spark, f"{folder}/opportunities").read()
    rows = rows.where(F.col("source_id") == source_id) if rows is not None else None
    if rows is None or rows.isEmpty():
        raise LookupError(f"no data for {source_id}")
    lists = ("required_certificates", "required_languages", "preferred_languages")
    schema = ", ".join(f"{f} struct<value:{'array<string>' if f in lists else 'string'},provenance:string>" for f in DERIVED)
    read = rows.withColumn("_d", F.from_json("enriched", schema)).select("*", "_d.*").drop("_d")
    return reports.coverage(read, [f for f in PLAIN if f in rows.columns], DERIVED)


def evaluate(gold: DataFrame, predictions: DataFrame, log: ParquetTable | None = None, prompt_version: str = PROMPT_VERSION, model_id: str = "model") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics of each run, their spread, disagreements) of both fields, over all records and the no-signal ones.

    gold and predictions as evaluation.GOLD and PREDICTION. With a log, each run's metrics are appended to it.
    """
    rows = evaluation.aligned(gold, predictions)
    measured = evaluation.metrics(rows)
    if log is not None:
        log.append(reports.run_log(measured.withColumnRenamed("run", "run_no"), "evaluation", prompt_version, model_id))
    return measured, reports.spread(measured, evaluation.METRICS), evaluation.disagreements(rows)


def predict(spark: SparkSession, gold: DataFrame, folder: str, make_client: Callable[[], Client], runs: int, prompt_version: str, model_id: str) -> DataFrame:
    """Asks a client about every labelled text once per run, answers stored before they are read: rows as evaluation.PREDICTION."""
    everyone = gold.select("source_id", "external_id", "text").withColumns({"experience_level": F.lit(None).cast("string"), "required_certificates": F.lit(None).cast("string")})
    out = None
    for run in range(1, runs + 1):
        answers = refresh_cache(ParquetTable(spark, f"{folder}/run-{run}"), everyone, make_client, prompt_version, model_id)
        keyed = everyone.select("source_id", "external_id", F.sha2(plain_spaces(F.col("text")), 256).alias("content_hash"))
        got = keyed.join(answers.select("content_hash", "response"), "content_hash").select("source_id", "external_id", F.lit(str(run)).alias("run"), "response")
        out = got if out is None else out.unionByName(got)
    return out
