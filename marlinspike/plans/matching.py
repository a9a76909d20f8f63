"""Queries of the match score: pairs are the (person, posting) that a person has acted on, never all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.operators import enrich, scoring
from marlinspike.plans.common import EVENTS, POSTINGS, TEXT, STORED, once, once_sql
from marlinspike.session import table
from marlinspike.vocab import PROFESSIONS, STAGE_LEVELS

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Facts that the test profiles lack are made from the second they were created in, alike in Spark and SQL.
_STAGE = "CASE career_stage.value WHEN 'student' THEN 'entry' WHEN 'cadet' THEN 'entry' WHEN 'working' THEN 'working' WHEN 'returning' THEN 'experienced' END"
_SECOND = "cast(extract(second FROM created_at) AS int)"
_CODES = "CASE {s} % 4 WHEN 0 THEN array('NL','TZ') WHEN 1 THEN array('gb') WHEN 2 THEN array('TH','BQ') END"
_CERTS = "CASE {s} % 3 WHEN 0 THEN array('stcw','coc','gmdss','marine_medical') WHEN 1 THEN array() END"
_DIRS = "CASE {s} % 5 WHEN 0 THEN array('cruise','Diving') WHEN 1 THEN array() WHEN 2 THEN array('offshore') END"


def people(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, profile): test profiles with every fact that is scored."""
    s = _SECOND
    fact = lambda value, c="cast(1.0 AS double)": f"CASE WHEN {value} IS NOT NULL THEN named_struct('value', {value}, 'confidence', {c}) END"
    words = "transform(professions.value, x -> replace(lower(x), ' ', '_'))"
    strings = lambda sql: f"cast({sql.format(s=s)} AS array<string>)"
    goal = f"CASE WHEN {s} % 2 = 0 THEN named_struct('profession', CASE WHEN {s} % 4 = 0 THEN 'deck' END, 'direction', 'cruise', 'country', cast(null AS string)) END"
    rows = table(spark, d, "user_profiles").dropDuplicates(["user_id"]).selectExpr(
        "user_id",
        f"{fact(_STAGE, 'career_stage.confidence')} AS career_stage",
        f"{fact(words, 'professions.confidence')} AS professions",
        f"{fact('languages.value', 'languages.confidence')} AS languages",
        f"{fact(strings(_DIRS))} AS directions",
        f"{fact(strings(_CERTS))} AS certificates",
        f"{fact(strings(_CODES), 'cast(0.5 AS double)')} AS preferred_countries",
        f"{fact(strings(_CODES))} AS hiring_country",
        f"{fact(goal)} AS career_goal",
    )
    return rows.select("user_id", F.struct(*rows.columns[1:]).alias("profile"))


def postings(spark: SparkSession, d: str, wanted: DataFrame) -> DataFrame:
    """(opportunity_id, posting): the stored postings among `wanted` (opportunity_id) with their rule fields; no others are read by rules."""
    texts = once(spark, d, "normalized_opportunities").join(wanted.select(F.col("opportunity_id").alias("id")).distinct(), "id", "left_semi").select("id", "title", "description", "source_fields", F.expr(TEXT).alias("text"), F.col("recruitment_office_raw").alias("office"), F.col("location_raw").alias("place"))
    config = table(spark, d, "source_registry").select("source_id", "direction", "workplace_type_hint")
    rows = once(spark, d, "opportunities").select("id", "source_id", "type").join(texts, "id").join(config, "source_id", "left")
    rows = enrich.with_experience(enrich.with_languages(rows, F.lit(""), F.col("text")), F.col("text"))
    rows = rows.withColumns({"_p": enrich.longest_term(enrich.structured_text(F.col("source_fields")), PROFESSIONS), "_t": enrich.longest_term(F.col("title"), PROFESSIONS), "_certs": enrich.certificate_keys(F.col("text")), "_country": enrich.country_code(F.col("place")), "hiring_scope": enrich.hiring_scope(F.col("office"))})
    fields = {
        "type": F.col("type"),
        "profession": F.coalesce(enrich.inferred(F.col("_p"), 0.9), enrich.inferred(F.col("_t"), 0.75)),
        "direction": enrich.inferred(F.col("direction"), 1.0),
        "required_languages": enrich.inferred(F.col("required"), 0.9),
        "experience_level": F.col("experience_level"),
        "required_certificates": enrich.inferred(F.col("_certs"), 0.9),
        "country": F.when(~F.col("workplace_type_hint").eqNullSafe("vessel"), enrich.inferred(F.col("_country"), 0.9)),
        "hiring_scope": F.col("hiring_scope"),
    }
    return rows.select(F.col("id").alias("opportunity_id"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("posting"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, opportunity_id, verdicts, value, comparable_factors) of every pair in the journal."""
    pairs = once(spark, d, "behaviour_events").select("user_id", "opportunity_id").distinct()
    return scoring.score(pairs.join(people(spark, d), "user_id").join(postings(spark, d, pairs), "opportunity_id")).drop("profile", "posting")


def jn7_match_scores(spark: SparkSession, d: str) -> DataFrame:
    """JN7, MS1-MS12, AG11: the score of each pair."""
    return scored(spark, d).select("user_id", "opportunity_id", F.round("value", 6).alias("value"), "comparable_factors")


def ms_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """MS2-MS9: how often each factor comes out how, with its caveats and mean weight."""
    v = scored(spark, d).select(F.explode("verdicts").alias("v")).select("v.*")
    return v.groupBy("factor", "outcome").agg(F.count("*").alias("n"), F.count_if(F.size("caveats") > 0).alias("with_caveat"), F.round(F.avg("weight"), 6).alias("weight"))


def ms_evidence(spark: SparkSession, d: str) -> DataFrame:
    """FN28: the evidence of each verdict as text."""
    v = scored(spark, d).select("user_id", "opportunity_id", F.explode("verdicts").alias("v"))
    return v.select("user_id", "opportunity_id", "v.factor", "v.posting_evidence", "v.profile_evidence")


def fn27_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """FN27: content fingerprints of the profiles' stages and languages as they are stored."""
    rows = table(spark, d, "user_profiles").dropDuplicates(["user_id"]).selectExpr("user_id", "career_stage.value AS stage", "languages.value AS languages")
    return rows.select("user_id", scoring.fingerprint("user_id", "stage", "languages").alias("fingerprint"))


def sp_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the reference's code, from its plan: each person's three best postings, unknown scores last (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("value").desc_nulls_last(), "opportunity_id")
    return jn7_match_scores(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3")


QUERIES |= {f.__name__: f for f in (jn7_match_scores, ms_outcomes, ms_evidence, fn27_fingerprints, sp_ranked)}


def _sql() -> dict[str, str]:
    from marlinspike.plans.rules import SQL as rule

    lists = lambda sql: sql.format(s="s").replace("array(", "list_value(")
    stages = " OR ".join(f"(stage = '{s}' AND level IN ({', '.join(repr(x) for x in ls)}))" for s, ls in STAGE_LEVELS.items())
    fold = lambda x: f"list_transform({x}, lambda e: lower(e))"
    # Languages here are judged by the text alone; the rule's own query has a title that requires some by id.
    languages = rule["en7_languages"].replace("(coalesce(title, '') || CASE WHEN id % 10 = 3 THEN ' (Japanese Speaking)' ELSE '' END)", "''")
    base = f"""WITH u AS (SELECT *, extract(second FROM created_at)::INT AS s FROM {once_sql("user_profiles", "user_id")}),
pp AS (SELECT user_id, {_STAGE} AS stage, career_stage.confidence AS stage_c, list_transform(professions.value, lambda x: replace(lower(x), ' ', '_')) AS profs, professions.confidence AS profs_c, languages.value AS langs, languages.confidence AS langs_c,
  {lists(_DIRS)} AS dirs, {lists(_CERTS)}::VARCHAR[] AS certs, {lists(_CODES)} AS codes, s % 2 = 0 AS has_goal, CASE WHEN s % 4 = 0 THEN 'deck' END AS goal_p FROM u),
en1 AS ({rule["en1_profession"]}), en3 AS ({rule["en3_country"]}), en5 AS ({rule["en5_hiring_scope"]}), en6 AS ({rule["en6_certificates"]}), en7 AS ({languages}), en8 AS ({rule["en8_experience"]}),
oo AS (SELECT o.id, o.type, en1.profession AS prof, en1.confidence AS prof_c, r.direction AS dir, en7.required AS langs_r, en8.level, CASE WHEN en8.level = 'entry' THEN 0.95 ELSE 0.9 END AS level_c, en6.certificates AS certs_r, en3.country AS cty,
  en5.id IS NOT NULL AS has_scope, en5.anywhere, en5.country AS scope, en5.unresolved FROM {STORED} o JOIN {POSTINGS} n USING (id) LEFT JOIN source_registry r ON r.source_id = o.source_id LEFT JOIN en1 USING (id) LEFT JOIN en3 USING (id) LEFT JOIN en5 USING (id) LEFT JOIN en6 USING (id) LEFT JOIN en7 USING (id) LEFT JOIN en8 USING (id)),
pairs AS (SELECT DISTINCT user_id, opportunity_id FROM {EVENTS}),
x AS (SELECT pairs.user_id, pairs.opportunity_id, pp.* EXCLUDE (user_id), oo.* EXCLUDE (id) FROM pairs JOIN pp USING (user_id) JOIN oo ON oo.id = pairs.opportunity_id),
f AS (
  SELECT user_id, opportunity_id, 'profession' AS factor, CASE WHEN prof IS NULL OR profs IS NULL OR len(profs) = 0 THEN NULL ELSE list_contains({fold("profs")}, lower(prof)) END AS hit, prof_c * profs_c AS w, false AS caveat FROM x
  UNION ALL SELECT user_id, opportunity_id, 'direction', CASE WHEN dir IS NULL OR dirs IS NULL OR len(dirs) = 0 THEN NULL ELSE list_contains({fold("dirs")}, lower(dir)) END, 1.0, false FROM x
  UNION ALL SELECT user_id, opportunity_id, 'languages', CASE WHEN langs_r IS NULL OR langs IS NULL THEN NULL ELSE len(list_filter(string_split(langs_r, ','), lambda e: NOT list_contains({fold("langs")}, e))) = 0 END, 0.9 * langs_c, false FROM x
  UNION ALL SELECT user_id, opportunity_id, 'experience', CASE WHEN level IS NULL OR stage IS NULL THEN NULL ELSE ({stages}) END, level_c * stage_c, false FROM x
  UNION ALL SELECT user_id, opportunity_id, 'certificates', CASE WHEN certs_r IS NULL OR certs IS NULL THEN NULL WHEN len(list_filter(string_split(certs_r, ','), lambda e: NOT list_contains(certs, e))) = 0 THEN true WHEN type = 'internship' THEN NULL ELSE false END, 0.9,
    certs_r IS NOT NULL AND certs IS NOT NULL AND len(list_filter(string_split(certs_r, ','), lambda e: NOT list_contains(certs, e))) > 0 AND type <> 'internship' FROM x
  UNION ALL SELECT user_id, opportunity_id, 'country', CASE WHEN cty IS NULL OR codes IS NULL THEN NULL ELSE list_contains({fold("codes")}, lower(cty)) END, 0.9 * 0.5, false FROM x
  UNION ALL SELECT user_id, opportunity_id, 'hiring_country', CASE WHEN NOT has_scope OR codes IS NULL THEN NULL WHEN anywhere THEN true WHEN scope IS NULL THEN NULL ELSE list_contains({fold("codes")}, lower(scope)) END, CASE WHEN anywhere THEN 1.0 ELSE 0.9 END,
    has_scope AND codes IS NOT NULL AND NOT anywhere AND scope IS NULL FROM x
  UNION ALL SELECT user_id, opportunity_id, 'career_goal', CASE WHEN NOT has_goal OR (dir IS NULL AND (goal_p IS NULL OR prof IS NULL)) THEN NULL ELSE (dir IS NULL OR lower(dir) = 'cruise') AND (goal_p IS NULL OR prof IS NULL OR prof = goal_p) END,
    CASE WHEN goal_p IS NOT NULL AND prof IS NOT NULL THEN prof_c ELSE 1.0 END, false FROM x)
"""
    value = "CASE WHEN sum(CASE WHEN hit IS NOT NULL THEN w ELSE 0 END) > 0 THEN round(sum(CASE WHEN hit THEN w ELSE 0 END)::DOUBLE / sum(CASE WHEN hit IS NOT NULL THEN w ELSE 0 END), 6) END"
    scores = f"SELECT user_id, opportunity_id, {value} AS value, count(hit)::INT AS comparable_factors FROM f GROUP BY user_id, opportunity_id"
    joined = lambda c: f"array_to_string({c}, ', ')"
    ruled = lambda c: f"replace({c}, ',', ', ') || ' [rule]'"
    short = "certs_r IS NOT NULL AND certs IS NOT NULL AND len(list_filter(string_split(certs_r, ','), lambda e: NOT list_contains(certs, e))) > 0 AND type = 'internship'"
    texts = {
        "profession": (ruled("prof"), joined("profs")),
        "direction": (ruled("dir"), joined("dirs")),
        "languages": (ruled("langs_r"), f"coalesce(nullif({joined('langs')}, ''), CASE WHEN langs IS NOT NULL THEN 'none' END)"),
        "experience": (ruled("level"), "stage"),
        "certificates": (f"CASE WHEN {short} THEN 'internship: training is part of the offer' ELSE {ruled('certs_r')} END", f"coalesce(nullif({joined('certs')}, ''), CASE WHEN certs IS NOT NULL THEN 'none' END)"),
        "country": (ruled("cty"), joined("codes")),
        "hiring_country": ("CASE WHEN anywhere THEN 'hires anywhere [rule]' WHEN scope IS NOT NULL THEN scope || ' [rule]' ELSE unresolved END", joined("codes")),
        "career_goal": (
            "CASE WHEN has_goal THEN nullif(concat_ws(', ', CASE WHEN goal_p IS NOT NULL THEN 'profession=' || prof END, 'direction=' || dir), '') END",
            "CASE WHEN has_goal THEN concat_ws(', ', 'profession=' || goal_p, 'direction=cruise') END",
        ),
    }
    evidence = " UNION ALL ".join(f"SELECT user_id, opportunity_id, '{k}' AS factor, {a} AS posting_evidence, {b} AS profile_evidence FROM x" for k, (a, b) in texts.items())
    return {
        "jn7_match_scores": base + scores,
        "ms_evidence": base + evidence,
        "fn27_fingerprints": f"""SELECT user_id, sha256('{{"user_id":"' || user_id || '","stage":' || coalesce('"' || career_stage.value || '"', 'null') || ',"languages":' || coalesce('[' || array_to_string(list_transform(languages.value, lambda x: '"' || x || '"'), ',') || ']', 'null') || '}}') AS fingerprint
FROM {once_sql("user_profiles", "user_id")}""",
        "ms_outcomes": base + "SELECT factor, CASE WHEN hit IS NULL THEN 'not_comparable' WHEN hit THEN 'match' ELSE 'mismatch' END AS outcome, count(*) AS n, count(*) FILTER (caveat) AS with_caveat, round(avg(CASE WHEN hit IS NULL THEN 0 ELSE w END)::DOUBLE, 6) AS weight FROM f GROUP BY 1, 2",
        "sp_ranked": base + f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, opportunity_id)::INT AS rank FROM ({scores}) QUALIFY rank <= 3",
    }


SQL |= _sql()
