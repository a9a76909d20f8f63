"""Configured feeds and the reader each platform needs."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marlinspike.sources import feeds


@dataclass(frozen=True)
class SourceConfig:
    source_id: str
    platform: str
    trust: str = "primary"
    direction: str | None = None
    workplace_type_hint: str | None = None
    account: str | None = None


@dataclass(frozen=True)
class Settings:
    """Settings, each from MARLINSPIKE_<NAME> where the environment has it."""

    user_agent: str = field(default_factory=lambda: os.environ.get("MARLINSPIKE_USER_AGENT", "marlinspike"))
    request_interval: float = field(default_factory=lambda: float(os.environ.get("MARLINSPIKE_REQUEST_INTERVAL", "1")))
    request_timeout: float = field(default_factory=lambda: float(os.environ.get("MARLINSPIKE_REQUEST_TIMEOUT", "30")))
    tables: str = field(default_factory=lambda: os.environ.get("MARLINSPIKE_TABLES", "tables"))


Reader = Callable[[SparkSession, str, str], DataFrame]
#: Platform -> reader of its feed files; further platforms are added here.
READERS: dict[str, Reader] = {"berthfeed": feeds.read_json_feed, "crewline": feeds.read_rss_feed, "reefboard": feeds.read_rss_feed}
#: Platforms whose feed belongs to an account.
NEEDS_ACCOUNT = {"account_feed"}


def configs(table: DataFrame, bound: int = 10_000) -> dict[str, SourceConfig]:
    """The registry table as configurations by source_id (at most `bound` rows, more raise)."""
    names = [c for c in ("source_id", "platform", "trust", "direction", "workplace_type_hint", "account") if c in table.columns]
    rows = table.select(*names).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError("the registry is too large to be a registry")
    return {r["source_id"]: SourceConfig(**r.asDict()) for r in rows}


def reader_for(known: dict[str, SourceConfig], source_id: str) -> Reader:
    """The reader of a source; an unknown source is a KeyError, an unknown platform or a missing account a ValueError."""
    config = known[source_id]
    if config.platform in NEEDS_ACCOUNT and not config.account:
        raise ValueError(f"{source_id} needs an account")
    if config.platform not in READERS:
        raise ValueError(f"unknown platform {config.platform}")
    return READERS[config.platform]
