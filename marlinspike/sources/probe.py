"""Probing candidate feed addresses: which answer, which are live, how many postings they list."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.sources.http import Polite

#: Keys under which platforms list their postings, tried in order; "" is the document itself.
LISTS = ("data", "jobs", "postings", "results", "content", "")
#: Public posting services: address of an employer's list, and the keys it stands under; fixed values.
PLATFORMS = (
    ("recruitee", "https://{slug}.recruitee.com/api/offers/", ("offers",)),
    ("greenhouse", "https://boards-api.greenhouse.io/v1/boards/{slug}/jobs", ("jobs",)),
    ("lever", "https://api.lever.co/v0/postings/{slug}?mode=json", ("",)),
    ("ashby", "https://api.ashbyhq.com/posting-api/job-board/{slug}", ("jobs",)),
    ("smartrecruiters", "https://api.smartrecruiters.com/v1/companies/{slug}/postings", ("content",)),
    ("workable", "https://apply.workable.com/api/v1/widget/accounts/{slug}?details=true", ("jobs",)),
    ("teamtailor", "https://{slug}.teamtailor.com/jobs.json", ("jobs", "data")),
    ("pinpoint", "https://{slug}.pinpointhq.com/postings.json", ("data",)),
)
PROBED = "platform string, slug string, url string, status string, postings int, sample string"
SAMPLED, SAMPLE_CHARS = 400, 60


def records(body: bytes, keys: tuple[str, ...] = LISTS) -> list | None:
    """The first list found under the keys, null if there is none; a document that is a list is one under any keys."""
    try:
        v = json.loads(body)
    except ValueError:
        return None
    if isinstance(v, list):
        return v
    return next((v[k] for k in keys if isinstance(v, dict) and isinstance(v.get(k), list)), None)


def listed(body: bytes, keys: tuple[str, ...] = LISTS) -> int | None:
    """Length of that list."""
    found = records(body, keys)
    return None if found is None else len(found)


def platforms(spark: SparkSession) -> DataFrame:
    """The known platforms as a table: platform, template, keys."""
    return spark.createDataFrame([(p, t, list(k)) for p, t, k in PLATFORMS], "platform string, template string, keys array<string>")


def candidates(platforms: DataFrame, employers: DataFrame) -> DataFrame:
    """(platform, slug, url, keys) of every employer on every platform; both are short lists, `template` holds {slug}.

    A small table of platforms is exploded onto the employers; it is aggregated to one row first, so no side is
    multiplied by tasks.
    """
    keyed = platforms if "keys" in platforms.columns else platforms.withColumn("keys", F.array(*[F.lit(k) for k in LISTS]))
    all_platforms = keyed.agg(F.collect_list(F.struct("platform", "template", "keys")).alias("ps"))
    return employers.select("slug").distinct().join(F.broadcast(all_platforms)).select(F.explode("ps").alias("p"), "slug").select("p.platform", "slug", F.replace("p.template", F.lit("{slug}"), F.col("slug")).alias("url"), "p.keys")


def probe(addresses: DataFrame, make_client: Callable[[], Polite]) -> DataFrame:
    """addresses with status ("live", "empty", "closed", "disallowed", "throttled"), postings and a title as a sample.

    One task per platform keeps each host's pauses; a throttled answer is told apart, since it says nothing
    about the address.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                n = sample = None
                try:
                    if not client.allowed(r.url):
                        status = "disallowed"
                    else:
                        found = records(client.get(r.url), tuple(r.keys))
                        n = None if found is None else len(found)
                        sample = next((str(x["title"])[:SAMPLE_CHARS] for x in (found or [])[:SAMPLED] if isinstance(x, dict) and x.get("title")), None)
                        status = "closed" if n is None else "live" if n else "empty"
                except OSError as e:
                    status = "throttled" if "429" in str(e) else "closed"
                out.append((r.platform, r.slug, r.url, status, n, sample))
            yield pd.DataFrame(out, columns=["platform", "slug", "url", "status", "postings", "sample"]).astype({"postings": "Int32"})

    return addresses.select("platform", "slug", "url", "keys").repartition("platform").mapInPandas(run, PROBED)


def summary(probed: DataFrame) -> DataFrame:
    """(platform, probed, live, postings, throttled)."""
    return probed.groupBy("platform").agg(F.count("*").alias("probed"), F.count_if(F.col("status") == "live").alias("live"), F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.count_if(F.col("status") == "throttled").alias("throttled"))


def write_found(probed: DataFrame, path: str) -> None:
    """The addresses that list postings as JSON, most postings first: a short report in one file."""
    probed.where("status = 'live'").select("platform", "slug", "url", "postings", "sample").orderBy(F.desc("postings"), "platform", "slug").coalesce(1).write.mode("overwrite").json(path)
