"""Completion of null fields by a model behind a cache: distinct questions, verified quotes, failures leave fields null."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.functions.text import literal_map, plain_spaces, quote_in, quoted
from marlinspike.operators.tables import ParquetTable
from marlinspike.vocab import CERTIFICATES, EXPERIENCE_LEVELS

CACHE = "content_hash string, prompt_version string, model_id string, response string"
KEY = ["content_hash", "prompt_version", "model_id"]
RESPONSE = "experience_level struct<value:string,quote:string,basis:string>, required_certificates array<struct<key:string,quote:string,basis:string>>"
BASIS = {"stated": 0.9, "inferred": 0.6}


class Client(Protocol):
    """Answers one text with a JSON object; raises on failure."""

    def extract(self, text: str) -> dict: ...


def needs_completion(postings: DataFrame, text: str = "text") -> DataFrame:
    """Postings in which a rule left experience or certificates null and whose text has at least 20 visible characters."""
    visible = F.length(F.regexp_replace(plain_spaces(F.col(text)), r"\s", ""))
    return postings.where((F.col("experience_level").isNull() | F.col("required_certificates").isNull()) & (visible >= 20))


def ask(postings: DataFrame, cache: DataFrame, make_client: Callable[[], Client], prompt_version: str, model_id: str, text: str = "text") -> DataFrame:
    """New cache rows: each distinct text that isn't cached is asked once; a failed call gives no row.

    Texts are made distinct by hash before the calls, so a text that very many postings share costs one call.
    """
    asked = (
        needs_completion(postings, text)
        .select(F.sha2(plain_spaces(F.col(text)), 256).alias("content_hash"), F.lit(prompt_version).alias("prompt_version"), F.lit(model_id).alias("model_id"), F.col(text).alias("text"))
        .groupBy(*KEY)
        .agg(F.first("text").alias("text"))
        .join(cache.select(*KEY), KEY, "left_anti")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    out.append((r.content_hash, r.prompt_version, r.model_id, json.dumps(client.extract(r.text))))
                except Exception:  # noqa: BLE001, S112  a failed call leaves the rule's null
                    continue
            yield pd.DataFrame(out, columns=[*KEY, "response"])

    return asked.mapInPandas(run, CACHE)


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows over old ones of the same key."""
    both = cache.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return both.groupBy(*KEY).agg(F.min_by("response", F.struct("_age", "response")).alias("response"))


def refresh_cache(table: ParquetTable, postings: DataFrame, make_client: Callable[[], Client], prompt_version: str, model_id: str, text: str = "text") -> DataFrame:
    """The stored cache after asking what it doesn't answer; the answers are written before anything reads them.

    A plan over ask() itself would ask again whenever it or a task of it runs again.
    """
    table.ensure(CACHE)
    answers = ParquetTable(table.spark, f"{table.path}/asked")
    answers.replace(ask(postings, table.read(), make_client, prompt_version, model_id, text))
    table.replace(merge_cache(table.read(), answers.read()))
    return table.read()


def named_by_quote(key: Column, quote: Column) -> Column:
    """Whether a quote names the certificate by one of its patterns; a certificate without patterns passes."""
    rx = {k: "|".join(rf"(?<!\w){quoted(p.lower())}(?!\w)" for p in ps) for k, ps in CERTIFICATES.items() if ps}
    pattern = F.try_element_at(literal_map(rx), key)
    return pattern.isNull() | F.rlike(F.lower(quote), pattern)


def complete(postings: DataFrame, cache: DataFrame, prompt_version: str, model_id: str, text: str = "text") -> DataFrame:
    """Postings with null fields filled from cached responses; fields that rules filled stay.

    A level needs a known value and basis and a quote that stands in the text; so does each certificate, whose
    quote must name it too. Of a certificate given twice the first counts; one inferred item makes the list
    inferred. The verified quotes stay with the value, by level or certificate, for its evidence.
    """
    hits = cache.where((F.col("prompt_version") == prompt_version) & (F.col("model_id") == model_id)).select("content_hash", F.from_json("response", RESPONSE).alias("_r"))
    joined = postings.withColumn("content_hash_", F.sha2(plain_spaces(F.col(text)), 256)).join(hits.withColumnRenamed("content_hash", "content_hash_"), "content_hash_", "left").drop("content_hash_")
    e = F.col("_r.experience_level")
    ok = e["value"].isin(*EXPERIENCE_LEVELS) & e["basis"].isin(*BASIS) & quote_in(F.col(text), e["quote"])
    level = F.when(ok, F.struct(e["value"].alias("value"), F.lit("llm").alias("provenance"), F.try_element_at(literal_map(BASIS), e["basis"]).alias("confidence"), F.create_map(e["value"], e["quote"]).alias("quotes")))
    items = F.filter(
        F.coalesce("_r.required_certificates", F.from_json(F.lit("[]"), "array<struct<key:string,quote:string,basis:string>>")),
        lambda c: F.coalesce(c["key"].isin(*CERTIFICATES) & c["basis"].isin(*BASIS) & quote_in(F.col(text), c["quote"]) & named_by_quote(c["key"], c["quote"]), F.lit(False)),
    )
    joined = joined.withColumn("_items", items).withColumn("_level", level)
    keys = F.array_distinct(F.transform("_items", lambda c: c["key"]))
    sure = F.when(F.exists("_items", lambda c: c["basis"] == "inferred"), 0.6).otherwise(0.9)
    first = F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter("_items", lambda c: c["key"] == k), F.lit(0))["quote"].alias("value")))
    certs = F.when(F.size("_items") > 0, F.struct(keys.alias("value"), F.lit("llm").alias("provenance"), sure.alias("confidence"), F.map_from_entries(first).alias("quotes")))
    return joined.withColumn("experience_level", F.coalesce("experience_level", "_level")).withColumn("required_certificates", F.coalesce("required_certificates", certs)).drop("_r", "_items", "_level")


class Retrying:
    """A client that repeats failed calls with growing pauses, at most `most` seconds each."""

    def __init__(self, inner: Client, retries: int = 2, pause: float = 0.5, most: float = 8.0):
        self.inner, self.retries, self.pause, self.most = inner, retries, pause, most

    def extract(self, text: str) -> dict:
        for k in range(self.retries + 1):
            try:
                return self.inner.extract(text)
            except (ConnectionError, TimeoutError, ValueError):
                if k == self.retries:
                    raise
                time.sleep(min(self.most, self.pause * 2**k))
        raise AssertionError
