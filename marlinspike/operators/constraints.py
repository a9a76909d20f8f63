"""Constraints of the data model as predicates: what breaks them is reported, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row breaks; a rule that can't be judged (null) isn't broken."""
    found = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("rule"))


def in_range(confidence: Column) -> Column:
    return confidence.between(0.0, 1.0)


def derived_rules(field: str) -> dict[str, Column]:
    """Rules of a derived value: what the source says is certain, and a confidence is a share."""
    f = F.col(field)
    return {f"{field}:source_not_certain": ~((f["provenance"] == "source") & (f["confidence"] != 1.0)), f"{field}:confidence": in_range(f["confidence"])}


def fact_rules(field: str) -> dict[str, Column]:
    """Rules of a fact: what a person stated is certain, and a confidence is a share."""
    f = F.col(field)
    return {f"{field}:stated_not_certain": ~((f["source"] == "stated") & (f["confidence"] != 1.0)), f"{field}:confidence": in_range(f["confidence"])}


def event_rules() -> dict[str, Column]:
    return {"dwell_negative": F.col("dwell_seconds") >= 0}


def raw_rules() -> dict[str, Column]:
    return {"content_hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"), "url": F.col("url").rlike("^https?://[^/?#]+")}


def goal_rules(goal: str = "career_goal") -> dict[str, Column]:
    v = F.col(goal)["value"]
    return {"goal_empty": F.when(v.isNotNull(), F.coalesce(v["profession"], v["direction"], v["country"]).isNotNull())}
