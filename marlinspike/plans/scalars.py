"""Queries of single functions and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions import text as fn
from marlinspike.operators import enrich, reports
from marlinspike.plans.common import POSTINGS, STORED, once, once_sql, sql_quote
from marlinspike.session import table
from marlinspike.vocab import CERTIFICATES, COUNTRIES, LANGUAGES, PROFESSIONS, STAGE_LEVELS, terms

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MARKED = "('<p>' || coalesce(title, '') || '</p> <b>' || coalesce(employer, '') || '</b>')"


@query(f"SELECT id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT id, {_MARKED} AS html FROM {POSTINGS})")
def fn5_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    """FN5: markup to one line."""
    return once(spark, d, "normalized_opportunities").select("id", fn.strip_markup(F.expr(_MARKED)).alias("text"))


@query(f"SELECT id, lower(trim(title)) AS folded, regexp_replace(title, '^#\\d+\\s+', '') AS bare FROM {POSTINGS}")
def fn14_titles(spark: SparkSession, d: str) -> DataFrame:
    """FN13, FN14: titles folded, and without a leading number."""
    return once(spark, d, "normalized_opportunities").select("id", F.lower(F.trim("title")).alias("folded"), F.regexp_replace("title", r"^#\d+\s+", "").alias("bare"))


@query(f"SELECT id, nullif(trim(location_raw), '') AS place, nullif(trim(employer), '') AS employer FROM {POSTINGS}")
def fn23_optional(spark: SparkSession, d: str) -> DataFrame:
    """FN23: blank texts are null."""
    return once(spark, d, "normalized_opportunities").select("id", fn.optional(F.col("location_raw")).alias("place"), fn.optional(F.col("employer")).alias("employer"))


@query("SELECT user_id, array_to_string(list_transform(l, lambda x: upper(x)), ',') AS codes, len(list_filter(l, lambda x: NOT regexp_matches(upper(x), '^[A-Z]{2}$'))) AS bad FROM (SELECT user_id, any_value(languages.value) AS l FROM user_profiles GROUP BY user_id) WHERE l IS NOT NULL")
def fn24_codes(spark: SparkSession, d: str) -> DataFrame:
    """FN24: two-letter codes in capitals, and how many entries aren't any."""
    rows = table(spark, d, "user_profiles").groupBy("user_id").agg(F.first("languages.value", ignorenulls=True).alias("l")).where("l is not null")
    return rows.select("user_id", F.array_join(F.transform("l", F.upper), ",").alias("codes"), F.size(F.filter("l", lambda x: ~F.upper(x).rlike("^[A-Z]{2}$"))).cast("long").alias("bad"))


_LABELLED = "(coalesce(description, '') || chr(10) || 'location: ' || coalesce(location_raw, '') || chr(10) || 'End')"


@query(f"SELECT id, nullif(trim(regexp_extract(t, '(?im)^Location:[ \\t]*(\\S.*)$', 1)), '') AS place FROM (SELECT id, {_LABELLED} AS t FROM {POSTINGS})")
def pr5_labelled_line(spark: SparkSession, d: str) -> DataFrame:
    """PR5: what a labelled line says."""
    return once(spark, d, "normalized_opportunities").select("id", fn.labelled_line(F.expr(_LABELLED), "Location").alias("place"))


@query(f"SELECT id, length(coalesce(description, '')) AS chars, CASE WHEN description IS NULL THEN '' ELSE description END AS text FROM {POSTINGS}")
def pr14_qualification_text(spark: SparkSession, d: str) -> DataFrame:
    """PR14: the text that states requirements (here always the description)."""
    rows = once(spark, d, "normalized_opportunities").select("id", enrich.qualification_text(F.col("source_fields"), F.col("description")).alias("text"))
    return rows.select("id", F.length("text").cast("long").alias("chars"), "text")


_VOCABULARIES = {"professions": PROFESSIONS, "countries": COUNTRIES, "certificates": CERTIFICATES, "languages": LANGUAGES}
_VALUES = ", ".join(f"('{v}', '{k}', '{sql_quote(t)}', {i})" for v, words in _VOCABULARIES.items() for k, t, i in terms(words))


@query(f"SELECT * FROM (VALUES {_VALUES}) AS t(vocabulary, key, term, ord)")
def sc8_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """SC8: the vocabularies as a table of terms in their order."""
    rows = [(v, k, t, i) for v, words in _VOCABULARIES.items() for k, t, i in terms(words)]
    return spark.createDataFrame(rows, "vocabulary string, key string, term string, ord int")


_LEVELS = " OR ".join(f"(stage = '{s}' AND level = '{x}')" for s, xs in STAGE_LEVELS.items() for x in xs)
_STAGE = "CASE career_stage.value WHEN 'student' THEN 'entry' WHEN 'cadet' THEN 'entry' WHEN 'working' THEN 'working' WHEN 'returning' THEN 'experienced' END"
_ALL = ", ".join(f"'{x}'" for x in ("entry", "junior", "mid", "senior", "lead"))


@query(f"SELECT user_id, level, coalesce({_LEVELS}, false) AS fits FROM (SELECT user_id, {_STAGE} AS stage, unnest([{_ALL}]) AS level FROM {once_sql('user_profiles', 'user_id')}) WHERE stage IS NOT NULL")
def jn8_stage_levels(spark: SparkSession, d: str) -> DataFrame:
    """JN8: which levels each person's stage accepts."""
    accepted = F.create_map(*[x for s, ls in STAGE_LEVELS.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in ls]))])
    rows = table(spark, d, "user_profiles").dropDuplicates(["user_id"]).select("user_id", F.expr(_STAGE).alias("stage"), F.explode(F.expr(f"array({_ALL})")).alias("level")).where("stage is not null")
    return rows.select("user_id", "level", F.array_contains(F.try_element_at(accepted, F.col("stage")), F.col("level")).alias("fits"))


_LEVEL = "CASE id % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'mid' END"


@query(f"SELECT source_id, {_LEVEL} AS level, count(*) AS records, count(*) FILTER (id % 3 = 0) AS with_certificates, count(*) FILTER (id % 2 = 0 AND ({_LEVEL} IS NOT NULL OR id % 3 = 0)) AS no_signal_filled FROM {POSTINGS} GROUP BY 1, 2")
def ag15_gold_profile(spark: SparkSession, d: str) -> DataFrame:
    """AG15: what a labelled set consists of."""
    gold = once(spark, d, "normalized_opportunities").selectExpr("source_id", f"{_LEVEL} AS level", "CASE WHEN id % 3 = 0 THEN array('stcw') ELSE array() END AS certificates", "CASE WHEN id % 2 = 0 THEN 'no-signal' ELSE 'both' END AS stratum")
    return reports.gold_profile(gold)


@query(f"SELECT id, salary.value.currency || ': ' || coalesce(salary.value.period, '-') || ' [' || salary.provenance || ']' AS cited, coalesce(array_to_string(list_sort(map_keys(salary.quotes)), ','), '') AS quoted FROM {STORED} WHERE salary.value IS NOT NULL")
def fn28_citations(spark: SparkSession, d: str) -> DataFrame:
    """FN28: stored pay cited with where it comes from, and what is quoted for it."""
    s = F.col("salary")
    cited = F.concat(s["value"]["currency"], F.lit(": "), F.coalesce(s["value"]["period"], F.lit("-")), F.lit(" ["), s["provenance"], F.lit("]"))
    return once(spark, d, "opportunities").where("salary.value is not null").select("id", cited.alias("cited"), F.coalesce(F.array_join(F.array_sort(F.map_keys(s["quotes"])), ","), F.lit("")).alias("quoted"))
