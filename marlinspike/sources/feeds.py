"""Feed payloads to postings in the source's own vocabulary: JSON bulk feeds and RSS items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions.text import address, content_hash, html_to_text, labelled_line, optional, requirements_block, rfc822, rough_language, tail, unescape

#: One posting of the JSON bulk feed; the part of it that is read.
JSON_POSTING = """id string, url string, title string, description string, key_responsibilities_header string, key_responsibilities string,
    skills_knowledge_expertise_header string, skills_knowledge_expertise string, benefits_header string, benefits string,
    employment_type string, compensation string, location struct<name:string,city:string>,
    job struct<division:struct<name:string>,department:struct<name:string>,structure_custom_group_one:struct<name:string>>"""
RSS_ITEM = "title string, link string, guid string, pubDate string, description string, location string, salary string, category string, featured string, sector string, employer string, RecuiterJobNumber string, PostDate string, expiryDate string"


def _needed(value: Column, of: str, name: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"{of} without {name}")).cast("string")).otherwise(value)


def json_feed_items(documents: DataFrame, source_id: str, text: str = "value") -> DataFrame:
    """Raw items of whole JSON feed documents ({"data": [posting, ...]}): source_id, external_id, url, payload, content_hash.

    A document without a data list fails the read; so does a posting without id or url. The content type isn't
    looked at.
    """
    v = F.try_parse_json(F.col(text))
    items = F.from_json(F.to_json(F.try_variant_get(v, "$.data", "variant")), "array<variant>")
    checked = F.when(items.isNull(), F.raise_error(F.lit("feed has no list of postings"))).otherwise(items)
    rows = documents.select(F.explode(checked).alias("v"))
    ext, url = F.try_variant_get("v", "$.id", "string"), F.try_variant_get("v", "$.url", "string")
    return rows.select(F.lit(source_id).alias("source_id"), _needed(ext, "posting", "id").alias("external_id"), _needed(url, "posting", "url").alias("url"), F.to_json("v").alias("payload")).withColumn("content_hash", content_hash(F.col("payload")))


def read_json_feed(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """json_feed_items() over files, one document each."""
    return json_feed_items(spark.read.text(path, wholetext=True), source_id)


def rss_feed_items(documents: DataFrame, source_id: str, text: str = "value") -> DataFrame:
    """Raw items of whole RSS documents, each <item> as it is written; one without an id or a link fails the read."""
    items = documents.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))).alias("payload"))
    read = items.withColumn("x", F.from_xml("payload", RSS_ITEM, {"mode": "PERMISSIVE"}))
    ext = F.coalesce(rss_id(F.col("x.guid")), optional(F.col("x.RecuiterJobNumber")))
    return read.select(F.lit(source_id).alias("source_id"), _needed(ext, "item", "id").alias("external_id"), _needed(optional(F.col("x.link")), "item", "link").alias("url"), "payload", content_hash(F.col("payload")).alias("content_hash"))


def read_rss_feed(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """rss_feed_items() over files, one document each."""
    return rss_feed_items(spark.read.text(path, wholetext=True), source_id)


def rss_id(guid: Column) -> Column:
    """The digits after /vacId/ in an item's guid, null without."""
    return F.nullif(F.regexp_extract(guid, r"/vacId/(\d+)", 1), F.lit(""))


def one_posting(payload: Column) -> Column:
    """The posting in a JSON payload: itself, the only one of a data list, or the one under posting."""
    v = F.try_parse_json(payload)
    inner = F.coalesce(F.try_variant_get(v, "$.data[0]", "variant"), F.try_variant_get(v, "$.posting", "variant"), v)
    return F.from_json(F.to_json(inner), JSON_POSTING)


def section(header: Column, body: Column) -> Column:
    """A section's text under its header line, null if it has no text."""
    text = html_to_text(body)
    return F.when(text.isNotNull(), F.concat_ws("\n", optional(header), text))


def from_json_payload(raw: DataFrame) -> DataFrame:
    """Postings of JSON payloads: the employer is the custom group, the location's name is the recruiting office.

    Payloads that aren't JSON give no row; absent parts are null.
    """
    p = F.col("p")
    parts = [html_to_text(p["description"]), section(p["key_responsibilities_header"], p["key_responsibilities"]), section(p["skills_knowledge_expertise_header"], p["skills_knowledge_expertise"]), section(p["benefits_header"], p["benefits"])]
    fields = {"department": p["job"]["department"]["name"], "division": p["job"]["division"]["name"], "skills_knowledge_expertise": html_to_text(p["skills_knowledge_expertise"]), "additional_requirements": html_to_text(p["benefits"])}
    shaped = raw.where(F.col("payload").rlike(r"^\s*[{\[]")).withColumn("p", one_posting(F.col("payload"))).where(F.col("p.id").isNotNull())
    return shaped.select(
        "id",
        "source_id",
        F.coalesce(p["id"], F.col("external_id")).alias("external_id"),
        F.coalesce(p["url"], F.col("url")).alias("url"),
        optional(p["title"]).alias("title"),
        F.nullif(F.concat_ws("\n\n", *parts), F.lit("")).alias("description"),
        optional(p["job"]["structure_custom_group_one"]["name"]).alias("employer"),
        F.lit(None).cast("string").alias("location_raw"),
        optional(p["location"]["name"]).alias("recruitment_office_raw"),
        optional(p["compensation"]).alias("salary_raw"),
        F.lit(None).cast("timestamp").alias("posted_at"),
        optional(p["employment_type"]).alias("declared_type"),
        F.map_filter(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c)]), lambda _, x: x.isNotNull()).alias("source_fields"),
        "content_hash",
    ).withColumn("language", rough_language(F.col("description")))


def from_rss_payload(raw: DataFrame) -> DataFrame:
    """Postings of RSS item payloads; the pay stands in its own element, else in the text's closing lines.

    Items that aren't well formed give no row. The closing run of salary, join date and duration lines is cut
    off the description and kept as fields; "Location:" and "Requirements:" are read from the text.
    """
    item = F.from_xml(F.col("payload"), RSS_ITEM, {"mode": "PERMISSIVE"})
    shaped = raw.where(F.col("payload").rlike(r"(?s)^\s*<item\b.*</item>\s*$")).withColumn("x", item).where("x.title is not null or x.guid is not null").withColumn("body", html_to_text(F.col("x.description"))).withColumn("t", tail(F.col("body")))
    text = F.coalesce("t.description", F.when(F.col("t").isNull(), F.col("body")))
    fields = {"sector": F.regexp_replace(optional(F.col("x.sector")), r"^\d+\.\s*", ""), "featured": optional(F.col("x.featured")), "expires": optional(F.col("x.expiryDate")), "join_date": F.col("t.join_date"), "duration": F.col("t.duration"), "additional_requirements": requirements_block(text)}
    return shaped.select(
        "id",
        "source_id",
        F.coalesce(rss_id(F.col("x.guid")), optional(F.col("x.RecuiterJobNumber")), F.col("external_id")).alias("external_id"),
        F.coalesce(optional(F.col("x.link")), F.col("url")).alias("url"),
        unescape(optional(F.col("x.title"))).alias("title"),
        text.alias("description"),
        optional(F.col("x.employer")).alias("employer"),
        F.coalesce(address(F.col("x.location")), labelled_line(text, "Location")).alias("location_raw"),
        F.lit(None).cast("string").alias("recruitment_office_raw"),
        F.coalesce(optional(F.col("x.salary")), F.col("t.salary")).alias("salary_raw"),
        F.coalesce(rfc822(F.col("x.pubDate")), rfc822(F.col("x.PostDate"))).alias("posted_at"),
        F.coalesce(optional(F.col("x.category")), F.lit("job")).alias("declared_type"),
        F.map_filter(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c)]), lambda _, x: x.isNotNull()).alias("source_fields"),
        "content_hash",
    ).withColumn("language", rough_language(F.col("description")))


def normalize(raw: DataFrame) -> DataFrame:
    """Postings of all payloads that can be read, by their own form and whatever the content type says."""
    return from_json_payload(raw).unionByName(from_rss_payload(raw))


def quarantine(raw: DataFrame) -> DataFrame:
    """(id, source_id, error) of payloads that can't be read: none, broken, an error page, or a foreign form."""
    p = F.col("payload")
    why = (
        F.when(p.isNull() | (F.trim(p) == ""), "empty")
        .when(p.rlike(r"^\s*[{\[]") & F.try_parse_json(p).isNull(), "broken_json")
        .when(p.rlike(r"^\s*[{\[]") & one_posting(p)["id"].isNull(), "no_posting")
        .when(p.rlike(r"^\s*<item>") & ~p.rlike(r"(?s)</item>\s*$"), "broken_xml")
        .when(~p.rlike(r"^\s*([{\[]|<item>)"), "foreign_form")
    )
    return raw.select("id", "source_id", why.alias("error")).where("error is not null")


__all__ = ["from_json_payload", "from_rss_payload", "normalize", "quarantine", "read_json_feed", "read_rss_feed"]
