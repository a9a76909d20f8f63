"""Latest versions, quality gate and classification of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlinspike.functions.text import host, literal_map, scheme
from marlinspike.vocab import DECLARED_TYPES, JUNK_TITLES, TYPE_KEYWORDS

POSTING = ("source_id", "external_id")


def latest_versions(raw: DataFrame) -> DataFrame:
    """The newest fetched version of each posting: greatest (fetched_at, id); null fetch times are oldest.

    A row-number filter that the planner turns into a per-task limit before the shuffle, so a posting with very
    many versions sends one row per task.
    """
    w = Window.partitionBy(*POSTING).orderBy(F.col("fetched_at").desc_nulls_last(), F.col("id").desc())
    return raw.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_contents(raw: DataFrame) -> DataFrame:
    """(source_id, content_hash) that stand under at least two different external ids of one source, over all versions.

    Two bounded aggregates (least and greatest id) decide it, so no group is gathered or joined with itself.
    """
    return raw.where("content_hash is not null").groupBy("source_id", "content_hash").agg(F.min("external_id").alias("lo"), F.max("external_id").alias("hi")).where("lo <> hi").select("source_id", "content_hash")


def quality_flags(title: Column, url: Column, description: Column, duplicate: Column) -> Column:
    """Flags in fixed order; a title is empty if it is blank or says nothing, a link needs http(s) and a host."""
    bare = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return F.array_compact(
        F.array(
            F.when(bare.isin("", *JUNK_TITLES), "empty_title"),
            F.when(~F.coalesce(scheme(url).isin("http", "https") & (F.length(host(url)) > 0), F.lit(False)), "invalid_url"),
            F.when(F.length(F.trim(F.coalesce(description, F.lit("")))) < 100, "description_too_short"),
            F.when(duplicate, "duplicate_content"),
        )
    )


def quality_score(flags: Column) -> Column:
    """1 less a quarter for every flag, at least 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.25) * F.size(flags))


def source_notes(url: Column) -> Column:
    """Notes neither reject nor lower the score."""
    return F.array_compact(F.array(F.when(F.contains(url, F.lit("__trashed")), "source_trashed")))


def gate(postings: DataFrame, raw: DataFrame) -> DataFrame:
    """postings with quality_flags, quality_score, quality_notes and status; raw gives the versions that duplicates are sought in.

    postings need content_hash, title, url and description. A row without hash is no duplicate. Both copies of
    a duplicated content are flagged.
    """
    twice = duplicate_contents(raw).withColumn("_dup", F.lit(True))
    flags = quality_flags(F.col("title"), F.col("url"), F.col("description"), F.coalesce("_dup", F.lit(False)))
    return (
        postings.join(twice, ["source_id", "content_hash"], "left")
        .withColumn("quality_flags", flags)
        .drop("_dup")
        .withColumn("quality_score", quality_score(F.col("quality_flags")))
        .withColumn("quality_notes", source_notes(F.col("url")))
        .withColumn("status", F.when(F.size("quality_flags") == 0, "active").otherwise("rejected"))
    )


def classification(declared: Column, title: Column) -> Column:
    """Struct (type, confidence): the declared type if known, else the first keyword in the title, else job."""
    low, keyword = F.lower(title), F.lit(None).cast("string")
    for word, kind in reversed(TYPE_KEYWORDS.items()):
        keyword = F.when(F.contains(low, F.lit(word)), kind).otherwise(keyword)
    known = F.try_element_at(literal_map(DECLARED_TYPES), F.lower(declared))
    return F.struct(
        F.coalesce(known, keyword, F.lit("job")).alias("type"), F.when(known.isNotNull(), 1.0).when(keyword.isNotNull(), 0.8).otherwise(0.5).alias("confidence")
    )
