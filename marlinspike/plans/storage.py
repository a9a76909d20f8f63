"""Queries of writes, joins, profiles, journal, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.operators import constraints, profiles, tables
from marlinspike.plans.common import EVENTS, POSTINGS, RAW, STORED, once, once_sql
from marlinspike.session import table
from marlinspike.vocab import CAREER_STAGES, DIRECTIONS, LANGUAGES, PROFESSIONS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


USERS = once_sql("user_profiles", "user_id")


@query(
    """WITH n AS (SELECT * FROM raw_items WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY source_id, external_id, content_hash ORDER BY id) = 1)
SELECT id, source_id, external_id, content_hash FROM n ANTI JOIN (SELECT * FROM raw_items WHERE id % 3 = 0) e USING (source_id, external_id, content_hash)"""
)
def sk1_raw_insert(spark: SparkSession, d: str) -> DataFrame:
    """SK1, JN10: which raw versions an insert adds, a third of the versions being stored before."""
    raw, old = table(spark, d, "raw_items"), F.col("id") % 3 == 0
    return tables.insert_new(raw.where(old), raw.where(~old), ["source_id", "external_id", "content_hash"], order=["id"]).select("id", "source_id", "external_id", "content_hash")


_BASE = f"(SELECT * FROM {STORED} QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY id) = 1)"


@query(
    f"""WITH b AS {_BASE}, o AS (SELECT * FROM b WHERE id % 4 <> 1), n AS (SELECT source_id, external_id, id + 1000000 AS id, 'rejected' AS status, quality_score / 2 AS quality_score, NULL::TIMESTAMPTZ AS first_seen_at FROM b WHERE id % 4 <= 1)
SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status,
coalesce(n.quality_score, o.quality_score) AS quality_score, epoch_us(CASE WHEN o.source_id IS NOT NULL THEN o.first_seen_at ELSE n.first_seen_at END) AS first_seen_us
FROM o FULL JOIN n ON o.source_id = n.source_id AND o.external_id = n.external_id"""
)
def sk2_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SK2: postings after an upsert that overwrites all but the time they were first seen."""
    cols = ["source_id", "external_id", "id", "status", "quality_score", "first_seen_at"]
    stored = once(spark, d, "opportunities")
    base = stored.groupBy("source_id", "external_id").agg(F.min_by(F.struct(*cols), "id").alias("r")).select("r.*")
    old = base.where("id % 4 <> 1")
    new = base.where("id % 4 <= 1").select("source_id", "external_id", (F.col("id") + 1000000).alias("id"), F.lit("rejected").alias("status"), (F.col("quality_score") / 2).alias("quality_score"), F.lit(None).cast("timestamp").alias("first_seen_at"))
    return tables.upsert(old, new, ["source_id", "external_id"], keep=["first_seen_at"]).withColumn("first_seen_at", F.unix_micros("first_seen_at")).withColumnRenamed("first_seen_at", "first_seen_us")


@query(
    f"""WITH c AS (SELECT DISTINCT sha256(coalesce(description, '')) AS h, id % 2 AS newer, id FROM {POSTINGS})
SELECT h AS content_hash, coalesce(max(CASE WHEN newer = 1 THEN 'new' END), 'old') AS response FROM c GROUP BY h"""
)
def sk3_cache_merge(spark: SparkSession, d: str) -> DataFrame:
    """SK3: a cache after putting rows of odd ids over rows of even ones."""
    from marlinspike.operators.completion import merge_cache

    rows = once(spark, d, "normalized_opportunities").select(F.sha2(F.coalesce("description", F.lit("")), 256).alias("content_hash"), F.lit("5").alias("prompt_version"), F.lit("m").alias("model_id"), "id")
    part = lambda k, name: rows.where(F.col("id") % 2 == k).drop("id").withColumn("response", F.lit(name))
    return merge_cache(part(0, "old"), part(1, "new")).select("content_hash", "response")


@query(
    f"""SELECT e.id, CASE WHEN u.user_id IS NULL THEN 'no_profile' WHEN e.dwell_seconds < 0 THEN 'negative_dwell' END AS error FROM {EVENTS} e LEFT JOIN (SELECT DISTINCT user_id FROM user_profiles) u USING (user_id)"""
)
def sk4_journal_append(spark: SparkSession, d: str) -> DataFrame:
    """SK4, JN9: events to append, and why some are refused."""
    accepted, refused = profiles.checked_events(once(spark, d, "behaviour_events"), table(spark, d, "user_profiles"))
    return accepted.select("id", F.lit(None).cast("string").alias("error")).unionByName(refused.select("id", "error"))


@query(f"SELECT DISTINCT user_id FROM {EVENTS} e ANTI JOIN (SELECT * FROM user_profiles WHERE user_id < '8') u USING (user_id)")
def sk5_create_absent(spark: SparkSession, d: str) -> DataFrame:
    """SK5: people of the journal for whom a profile has to be made."""
    known = table(spark, d, "user_profiles").where("user_id < '8'").select("user_id")
    return tables.insert_new(known, once(spark, d, "behaviour_events").select("user_id"), ["user_id"])


def fact_changes(events: DataFrame) -> DataFrame:
    """A change log made of the journal, alike in Spark and SQL: the test tables have none."""
    source = F.when(F.col("action") == "apply", "stated").when(F.col("action") == "save", "imported").otherwise("observed")
    return events.select(
        "user_id", F.when(F.col("opportunity_id") % 2 == 0, "goal").otherwise("stage").alias("field"), source.alias("source"), F.col("occurred_at").alias("at"), F.col("id").alias("seq"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), F.col("opportunity_id") % 10)).alias("value")
    )


_SOURCES = "CASE action WHEN 'apply' THEN 'stated' WHEN 'save' THEN 'imported' ELSE 'observed' END"
_CHANGES = f"SELECT user_id, CASE WHEN opportunity_id % 2 = 0 THEN 'goal' ELSE 'stage' END AS field, {_SOURCES} AS source, occurred_at AS t, id AS seq, CASE WHEN id % 5 <> 0 THEN 'v' || (opportunity_id % 10)::VARCHAR END AS value FROM {EVENTS}"


@query(
    f"""WITH c AS ({_CHANGES}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY t, seq) AS n FROM c),
l AS (SELECT user_id, field, max(n) AS last_n FROM n WHERE source = 'stated' GROUP BY ALL),
k AS (SELECT n.*, l.last_n, s.value IS NOT NULL AS kept FROM n LEFT JOIN l USING (user_id, field) LEFT JOIN n s ON s.user_id = n.user_id AND s.field = n.field AND s.n = l.last_n),
m AS (SELECT *, max(n) OVER (PARTITION BY user_id, field) AS top FROM k)
SELECT user_id, field, value, source, epoch_us(t) AS stated_us FROM m WHERE value IS NOT NULL AND CASE WHEN last_n IS NOT NULL AND kept THEN n = last_n ELSE n = top END"""
)
def sk6_fact_fold(spark: SparkSession, d: str) -> DataFrame:
    """SK6, SK7, PR9, SS5: facts after folding changes and clears, stated ones taking precedence."""
    log = fact_changes(once(spark, d, "behaviour_events"))
    return profiles.current_facts(log).select("user_id", "field", "value", "source", F.unix_micros("stated_at").alias("stated_us"))


@query(f"SELECT user_id, count(*) AS n FROM {EVENTS} WHERE user_id NOT IN (SELECT user_id FROM user_profiles WHERE user_id < '4') GROUP BY user_id")
def sk8_delete_people(spark: SparkSession, d: str) -> DataFrame:
    """SK8: the journal after some people were deleted, counted by person."""
    gone = table(spark, d, "user_profiles").where("user_id < '4'").select("user_id")
    return profiles.without_people(once(spark, d, "behaviour_events"), gone).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"SELECT u.user_id, e.id AS event_id, epoch_us(e.occurred_at) AS at_us, e.opportunity_id, e.action FROM {USERS} u LEFT JOIN {EVENTS} e USING (user_id)")
def sk9_export(spark: SparkSession, d: str) -> DataFrame:
    """SK9: everybody's export, a row per event in order."""
    out = profiles.export(table(spark, d, "user_profiles").select("user_id").distinct(), once(spark, d, "behaviour_events"))
    return out.select("user_id", "event_id", F.unix_micros("occurred_at").alias("at_us"), "opportunity_id", "action")


@query(f"SELECT user_id, count(id) AS events, string_agg(id::VARCHAR, ',' ORDER BY occurred_at, id) AS ids FROM (SELECT max(user_id) AS user_id FROM user_profiles) u LEFT JOIN {EVENTS} e USING (user_id) GROUP BY user_id")
def sk9_export_of_one(spark: SparkSession, d: str) -> DataFrame:
    """SK9, SC11: one named person's list of events."""
    people = table(spark, d, "user_profiles").select("user_id").distinct()
    out = profiles.export_of(people, once(spark, d, "behaviour_events"), people.agg(F.max("user_id")).first()[0])
    return out.select("user_id", F.size("events").alias("events").cast("long"), F.nullif(F.array_join(F.transform("events", lambda e: e["id"].cast("string")), ","), F.lit("")).alias("ids"))


@query(f"SELECT id, raw_item_id, status FROM {STORED} WHERE source_id = (SELECT min(source_id) FROM source_registry)")
def sc10_by_source(spark: SparkSession, d: str) -> DataFrame:
    """SC10, PR16: stored postings of one source."""
    first = table(spark, d, "source_registry").agg(F.min("source_id").alias("source_id"))
    return once(spark, d, "opportunities").join(first, "source_id", "left_semi").select("id", "raw_item_id", "status")


@query(f"SELECT user_id, id, action, epoch_us(occurred_at) AS at_us FROM {EVENTS} WHERE user_id = (SELECT max(user_id) FROM user_profiles)")
def sc12_journal_of_one(spark: SparkSession, d: str) -> DataFrame:
    """SC11, SC12, SO1: one person's journal in order of time and id."""
    one = table(spark, d, "user_profiles").agg(F.max("user_id").alias("user_id"))
    return once(spark, d, "behaviour_events").join(one, "user_id", "left_semi").orderBy("occurred_at", "id").select("user_id", "id", "action", F.unix_micros("occurred_at").alias("at_us"))


@query(
    f"""WITH x AS (SELECT id, sha256(coalesce(description, '')) AS h FROM {POSTINGS}), c AS (SELECT DISTINCT h FROM x WHERE id % 2 = 0)
SELECT id, c.h IS NOT NULL AS hit FROM x LEFT JOIN c USING (h)"""
)
def jn4_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN4, SC13: which texts a cache made of even ids answers."""
    rows = once(spark, d, "normalized_opportunities").select("id", F.sha2(F.coalesce("description", F.lit("")), 256).alias("h"))
    cache = rows.where("id % 2 = 0").select("h").distinct().withColumn("hit", F.lit(True))
    return rows.join(cache, "h", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(f"SELECT e.id, o.id IS NULL AS gone, o.status FROM {EVENTS} e LEFT JOIN {STORED} o ON o.id = e.opportunity_id")
def jn2_events_postings(spark: SparkSession, d: str) -> DataFrame:
    """JN2: events with their posting, also those on postings that are gone."""
    o = once(spark, d, "opportunities").select(F.col("id").alias("opportunity_id"), "status", F.lit(False).alias("here"))
    return once(spark, d, "behaviour_events").join(o, "opportunity_id", "left").select("id", F.col("here").isNull().alias("gone"), "status")


@query(f"SELECT id, source_id, external_id FROM {STORED} s ANTI JOIN (SELECT source_id, external_id FROM {POSTINGS} WHERE id % 3 = 0) USING (source_id, external_id)")
def jn12_not_labelled(spark: SparkSession, d: str) -> DataFrame:
    """JN12: stored postings that aren't labelled yet."""
    labelled = once(spark, d, "normalized_opportunities").where("id % 3 = 0").select("source_id", "external_id")
    return once(spark, d, "opportunities").join(labelled, ["source_id", "external_id"], "left_anti").select("id", "source_id", "external_id")


@query(f"SELECT o.id, r.id IS NOT NULL AS has_raw FROM {STORED} o LEFT JOIN {RAW} r ON r.id = o.raw_item_id")
def jn9_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """JN9, SC21: whether the raw version of each stored posting exists."""
    raw = once(spark, d, "raw_items").select(F.col("id").alias("raw_item_id"), F.lit(True).alias("here"))
    return once(spark, d, "opportunities").join(raw, "raw_item_id", "left").select("id", F.coalesce("here", F.lit(False)).alias("has_raw"))


_DIMS = f"(SELECT e.user_id, e.action, r.direction, o.type AS profession FROM {EVENTS} e LEFT JOIN {STORED} o ON o.id = e.opportunity_id LEFT JOIN source_registry r ON r.source_id = o.source_id)"


@query(
    f"""SELECT user_id, 'total' AS dimension, NULL AS key, action, count(*) AS n FROM {_DIMS} GROUP BY user_id, action
UNION ALL SELECT user_id, 'direction', direction, action, count(*) FROM {_DIMS} GROUP BY user_id, action, direction
UNION ALL SELECT user_id, 'profession', profession, action, count(*) FROM {_DIMS} GROUP BY user_id, action, profession"""
)
def ag1_interest_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG1: actions per person in total, by direction and by (here) type of posting."""
    o = once(spark, d, "opportunities").join(table(spark, d, "source_registry").select("source_id", "direction"), "source_id", "left").select("id", "direction", F.col("type").alias("profession"))
    return profiles.interest_counts(once(spark, d, "behaviour_events"), o)


_D = ", ".join(f"'{x}'" for x in DIRECTIONS)


@query(f"SELECT source_id, direction FROM source_registry WHERE direction IS NOT NULL AND direction NOT IN ({_D})")
def st8_unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    """ST8, FN25: registry directions that the vocabulary doesn't hold."""
    unknown = profiles.unknown_keys(F.array("direction"), DIRECTIONS)
    return table(spark, d, "source_registry").where(F.col("direction").isNotNull() & (F.size(unknown) > 0)).select("source_id", "direction")


@query("SELECT user_id, list_aggregate(list_sort(list_filter(list_transform(professions.value, lambda x: lower(x)), lambda x: contains(x, 'engineer'))), 'string_agg', ',') AS hits FROM (SELECT DISTINCT user_id, professions FROM user_profiles) WHERE professions IS NOT NULL")
def st2_list_overlap(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST2, FN13: list facts folded and filtered."""
    hits = F.array_sort(F.filter(F.transform("professions.value", F.lower), lambda x: F.contains(x, F.lit("engineer"))))
    return table(spark, d, "user_profiles").select("user_id", "professions").distinct().where("professions is not null").select("user_id", F.nullif(F.array_join(hits, ","), F.lit("")).alias("hits"))


def _agree(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


@query("SELECT user_id, list_sort(list_distinct(l)) = list_sort(list_distinct(p)) AS equal, array_to_string(list_sort(list_filter(list_distinct(l), lambda x: NOT list_contains(p, x))), ',') AS only_l FROM (SELECT user_id, coalesce(any_value(languages.value), []) AS l, coalesce(any_value(preferred_countries.value), []) AS p FROM user_profiles GROUP BY user_id)")
def st3_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """ST3, ST5, ST6, ST7: two list facts compared as sets."""
    none = F.array().cast("array<string>")
    rows = table(spark, d, "user_profiles").groupBy("user_id").agg(F.first("languages.value", ignorenulls=True).alias("l"), F.first("preferred_countries.value", ignorenulls=True).alias("p"))
    rows = rows.select("user_id", F.coalesce("l", none).alias("l"), F.coalesce("p", none).alias("p"))
    return rows.select("user_id", _agree(F.col("l"), F.col("p")).alias("equal"), F.array_join(F.array_sort(F.array_except("l", "p")), ",").alias("only_l"))


@query("SELECT source_id, external_id, 'raw' AS side FROM (SELECT source_id, external_id FROM raw_items EXCEPT SELECT source_id, external_id FROM opportunities) UNION ALL SELECT source_id, external_id, 'both' FROM (SELECT source_id, external_id FROM raw_items INTERSECT SELECT source_id, external_id FROM opportunities)")
def st9_keys_by_side(spark: SparkSession, d: str) -> DataFrame:
    """ST9: posting keys by where they stand, by set operations over tables."""
    keys = ["source_id", "external_id"]
    raw, stored = table(spark, d, "raw_items").select(*keys), table(spark, d, "opportunities").select(*keys)
    return raw.subtract(stored).withColumn("side", F.lit("raw")).unionByName(raw.intersect(stored).withColumn("side", F.lit("both")))


@query(f"SELECT source_id, EXISTS (SELECT 1 FROM {RAW} r WHERE r.source_id = g.source_id AND http_status >= 400) AS any_error FROM source_registry g")
def so4_existence(spark: SparkSession, d: str) -> DataFrame:
    """SO4: whether any fetch of a source failed; a semi-join stops at a source's first one."""
    failed = table(spark, d, "raw_items").where("http_status >= 400").select("source_id").distinct().withColumn("any_error", F.lit(True))
    return table(spark, d, "source_registry").select("source_id").join(failed, "source_id", "left").select("source_id", F.coalesce("any_error", F.lit(False)).alias("any_error"))


def _fact_sql(field: str) -> str:
    return f"""SELECT 'user_profiles' AS "table", user_id AS key, '{field}:stated_not_certain' AS rule FROM {USERS} WHERE {field}.source = 'stated' AND {field}.confidence <> 1.0
UNION ALL SELECT 'user_profiles', user_id, '{field}:confidence' FROM {USERS} WHERE NOT {field}.confidence BETWEEN 0 AND 1"""


_FACT_FIELDS = ("career_stage", "residence_country", "professions", "languages", "preferred_countries")


@query(
    " UNION ALL ".join(_fact_sql(f) for f in _FACT_FIELDS)
    + f""" UNION ALL SELECT 'opportunities', id::VARCHAR, 'salary:source_not_certain' FROM {STORED} WHERE salary.provenance = 'source' AND salary.confidence <> 1.0
UNION ALL SELECT 'opportunities', id::VARCHAR, 'salary:confidence' FROM {STORED} WHERE NOT salary.confidence BETWEEN 0 AND 1
UNION ALL SELECT 'behaviour_events', id::VARCHAR, 'dwell_negative' FROM {EVENTS} WHERE dwell_seconds < 0
UNION ALL SELECT 'raw_items', id::VARCHAR, 'content_hash' FROM {RAW} WHERE NOT regexp_full_match(content_hash, '[0-9a-f]{{64}}')
UNION ALL SELECT 'raw_items', id::VARCHAR, 'url' FROM {RAW} WHERE NOT regexp_matches(url, '^https?://[^/?#]+')"""
)
def pr19_constraints(spark: SparkSession, d: str) -> DataFrame:
    """PR19, SC21: every row of the tables that breaks a constraint of the data model, and which."""
    people = table(spark, d, "user_profiles").dropDuplicates(["user_id"])
    parts = [
        ("user_profiles", constraints.broken(people, "user_id", {k: v for f in _FACT_FIELDS for k, v in constraints.fact_rules(f).items()})),
        ("opportunities", constraints.broken(once(spark, d, "opportunities"), "id", constraints.derived_rules("salary"))),
        ("behaviour_events", constraints.broken(once(spark, d, "behaviour_events"), "id", constraints.event_rules())),
        ("raw_items", constraints.broken(once(spark, d, "raw_items"), "id", constraints.raw_rules())),
    ]
    named = [rows.select(F.lit(name).alias("table"), "key", "rule") for name, rows in parts]
    return reduce(DataFrame.unionByName, named)


_KNOWN = {"professions": list(PROFESSIONS), "languages": list(LANGUAGES)}


@query(
    " UNION ALL ".join(
        f"""SELECT '{f}' AS field, count(*) AS changes, count(*) FILTER (len(list_filter({f}.value, lambda x: x NOT IN ({", ".join(repr(k) for k in keys)}))) > 0) AS unknown_key FROM {USERS} WHERE {f}.value IS NOT NULL""" for f, keys in _KNOWN.items()
    )
    + f""" UNION ALL SELECT 'preferred_countries', count(*), count(*) FILTER (len(list_filter(preferred_countries.value, lambda x: NOT regexp_full_match(upper(x), '[A-Z][A-Z]'))) > 0) FROM {USERS} WHERE preferred_countries.value IS NOT NULL
UNION ALL SELECT 'residence_country', count(*), count(*) FILTER (NOT regexp_full_match(upper(residence_country.value), '[A-Z][A-Z]')) FROM {USERS} WHERE residence_country.value IS NOT NULL
UNION ALL SELECT 'career_stage', count(*), count(*) FILTER (career_stage.value NOT IN ({", ".join(repr(k) for k in CAREER_STAGES)})) FROM {USERS} WHERE career_stage.value IS NOT NULL"""
)
def sk6_checked_changes(spark: SparkSession, d: str) -> DataFrame:
    """SK6, FN25: the stored facts as changes, checked against the vocabularies, by field."""
    people = table(spark, d, "user_profiles").dropDuplicates(["user_id"])
    single = ("career_stage", "residence_country")
    facts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.source").alias("source"), F.col(f"{f}.confidence").alias("confidence"), F.col(f"{f}.stated_at").alias("at"), (F.when(F.col(f"{f}.value").isNotNull(), F.array(f"{f}.value")) if f in single else F.col(f"{f}.value")).alias("items")) for f in _FACT_FIELDS])
    changes = people.select("user_id", F.explode(facts).alias("x")).select("user_id", "x.*", F.lit(0).cast("long").alias("seq")).where("items is not null")
    return profiles.checked_changes(changes).groupBy("field").agg(F.count("*").alias("changes"), F.count_if(F.array_contains("errors", "unknown_key")).alias("unknown_key"))
