"""Queries of the gate, the classification and the rule enrichment.

Rules read texts where they lie; what a shuffle takes to drop rows delivered twice is their results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions import text as fn
from marlinspike.operators import enrich, gate
from marlinspike.plans.common import POSTINGS, RAW, TEXT, TITLE, WB, WE, once, sql_regex
from marlinspike.session import spread, table
from marlinspike.vocab import CERTIFICATES, COUNTRIES, DECLARED_TYPES, JUNK_TITLES, LANGUAGES, PROFESSIONS, TYPE_KEYWORDS, terms

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _longest(text: str, vocabulary: dict[str, list[str]]) -> str:
    ordered = sorted(terms(vocabulary), key=lambda t: (-len(t[1]), t[2]))
    whens = " ".join(f"WHEN regexp_matches(lower({text}), '{WB}{sql_regex(t.lower())}') THEN '{k}'" for k, t, _ in ordered)
    return f"CASE {whens} END"


LATEST = f"""(SELECT * FROM {RAW} QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1)"""


@query(f"SELECT id, source_id, external_id, epoch_us(fetched_at) AS fetched_us, content_hash FROM {LATEST}")
def wn1_latest_versions(spark: SparkSession, d: str) -> DataFrame:
    """WN1, SC9, JN1: the newest version of each posting."""
    return gate.latest_versions(once(spark, d, "raw_items")).select("id", "source_id", "external_id", F.unix_micros("fetched_at").alias("fetched_us"), "content_hash")


_TWINS = f"(SELECT source_id, content_hash FROM {RAW} WHERE content_hash IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT external_id) > 1)"


@query(f"SELECT DISTINCT r.id, r.source_id, r.external_id FROM {RAW} r SEMI JOIN {_TWINS} t USING (source_id, content_hash)")
def jn3_duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    """JN3: raw versions whose content stands under another external id of the source too."""
    raw = once(spark, d, "raw_items")
    return raw.join(gate.duplicate_contents(raw), ["source_id", "content_hash"], "left_semi").select("id", "source_id", "external_id")


def _gated(spark: SparkSession, d: str) -> DataFrame:
    raw = once(spark, d, "raw_items")
    hashes = gate.latest_versions(raw).select("source_id", "external_id", "content_hash")
    postings = once(spark, d, "normalized_opportunities").join(hashes, ["source_id", "external_id"], "left")
    return gate.gate(postings, raw)


_JUNK = ", ".join(f"'{j}'" for j in ["", *JUNK_TITLES])
GATED = f"""(SELECT *, greatest(0.0, 1.0 - 0.25 * len(quality_flags))::DOUBLE AS quality_score,
  CASE WHEN url LIKE '%\\_\\_trashed%' ESCAPE '\\' THEN ['source_trashed'] ELSE [] END AS quality_notes,
  CASE WHEN len(quality_flags) = 0 THEN 'active' ELSE 'rejected' END AS status FROM (
  SELECT n.*, l.content_hash, list_filter([
    CASE WHEN lower(trim(coalesce(n.title, ''))) IN ({_JUNK}) THEN 'empty_title' END,
    CASE WHEN NOT coalesce(regexp_matches(n.url, '^https?://[^/?#]+'), false) THEN 'invalid_url' END,
    CASE WHEN length(trim(coalesce(n.description, ''), ' ')) < 100 THEN 'description_too_short' END,
    CASE WHEN t.content_hash IS NOT NULL THEN 'duplicate_content' END], lambda x: x IS NOT NULL) AS quality_flags
  FROM {POSTINGS} n LEFT JOIN {LATEST} l USING (source_id, external_id) LEFT JOIN {_TWINS} t ON t.source_id = n.source_id AND t.content_hash = l.content_hash))"""


@query(f"SELECT id, array_to_string(quality_flags, ',') AS flags, quality_score, array_to_string(quality_notes, ',') AS notes, status FROM {GATED}")
def pr10_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """PR10, PR11, PR12: flags, score, notes and status of every posting."""
    return _gated(spark, d).select("id", F.array_join("quality_flags", ",").alias("flags"), "quality_score", F.array_join("quality_notes", ",").alias("notes"), "status")


_TYPE = " ".join(f"WHEN contains(lower(title), '{w}') THEN '{k}'" for w, k in TYPE_KEYWORDS.items())
_KNOWN = " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in DECLARED_TYPES.items())


@query(
    f"""SELECT id, coalesce(k, w, 'job') AS type, (CASE WHEN k IS NOT NULL THEN 1.0 WHEN w IS NOT NULL THEN 0.8 ELSE 0.5 END)::DOUBLE AS confidence
FROM (SELECT id, CASE lower(declared_type) {_KNOWN} END AS k, CASE {_TYPE} END AS w FROM {POSTINGS})"""
)
def pr13_classify(spark: SparkSession, d: str) -> DataFrame:
    """PR13, WN3: the type of every posting."""
    return spread(table(spark, d, "normalized_opportunities")).select("id", gate.classification(F.col("declared_type"), F.col("title")).alias("c")).select("id", "c.type", "c.confidence").dropDuplicates(["id"])


@query(
    f"""SELECT id, coalesce(s, t) AS profession, (CASE WHEN s IS NOT NULL THEN 0.9 WHEN t IS NOT NULL THEN 0.75 END)::DOUBLE AS confidence FROM (
SELECT id, {_longest("map_extract_value(source_fields, 'department')", PROFESSIONS)} AS s, {_longest("title", PROFESSIONS)} AS t FROM {POSTINGS})"""
)
def en1_profession(spark: SparkSession, d: str) -> DataFrame:
    """EN1, JN5, WN2: profession by structured field, else by title; the longest alias wins."""
    p = enrich.profession(enrich.structured_text(F.col("source_fields")), F.col("title"))
    return spread(table(spark, d, "normalized_opportunities")).select("id", p.alias("p")).select("id", F.col("p.value").alias("profession"), F.col("p.confidence")).dropDuplicates(["id"])


@query(f"SELECT n.id, r.direction, r.workplace_type_hint AS workplace FROM {POSTINGS} n LEFT JOIN source_registry r USING (source_id)")
def en2_source_config(spark: SparkSession, d: str) -> DataFrame:
    """EN2, JN6: direction and workplace from the source's configuration."""
    config = table(spark, d, "source_registry").select("source_id", "direction", F.col("workplace_type_hint").alias("workplace"))
    return spread(table(spark, d, "normalized_opportunities")).join(config, "source_id", "left").select("id", "direction", "workplace").dropDuplicates(["id"])


@query(
    f"""SELECT id, CASE WHEN workplace_type_hint IS DISTINCT FROM 'vessel' THEN {_longest("place", COUNTRIES)} END AS country
FROM (SELECT id, source_id, location_raw AS place FROM {POSTINGS}) LEFT JOIN source_registry USING (source_id)"""
)
def en3_country(spark: SparkSession, d: str) -> DataFrame:
    """EN3: country of work of shore postings, the longest name wins."""
    rows = spread(table(spark, d, "normalized_opportunities")).join(table(spark, d, "source_registry").select("source_id", "workplace_type_hint"), "source_id", "left")
    return rows.select("id", enrich.country(F.col("location_raw"), F.col("workplace_type_hint"))["value"].alias("country")).dropDuplicates(["id"])


@query(
    f"""SELECT id, lower(head) = 'global' AS anywhere, CASE WHEN lower(head) <> 'global' THEN code END AS country, CASE WHEN lower(head) <> 'global' AND code IS NULL THEN head END AS unresolved
FROM (SELECT id, head, {_longest("head", COUNTRIES)} AS code FROM (SELECT id, trim(string_split_regex(recruitment_office_raw, '\\s[-–]\\s')[1]) AS head FROM {POSTINGS})) WHERE length(head) > 0"""
)
def en5_hiring_scope(spark: SparkSession, d: str) -> DataFrame:
    """EN5: what the recruiting office says about who is hired."""
    s = enrich.hiring_scope(F.col("recruitment_office_raw"))
    rows = spread(table(spark, d, "normalized_opportunities")).select("id", s.alias("s")).where("s is not null")
    return rows.select("id", "s.anywhere", F.get("s.countries", F.lit(0)).alias("country"), F.get("s.unresolved", F.lit(0)).alias("unresolved")).dropDuplicates(["id"])


_CERTS = ", ".join(f"CASE WHEN regexp_matches(t, '{WB}({'|'.join(sql_regex(p.lower()) for p in ps)}){WE}') THEN '{k}' END" for k, ps in CERTIFICATES.items() if ps)


@query(f"SELECT id, nullif(array_to_string(list_filter([{_CERTS}], lambda x: x IS NOT NULL), ','), '') AS certificates FROM (SELECT id, lower({TEXT}) AS t FROM {POSTINGS})")
def en6_certificates(spark: SparkSession, d: str) -> DataFrame:
    """EN6: certificates that a text names, in the vocabulary's order."""
    return spread(table(spark, d, "normalized_opportunities")).select("id", F.array_join(enrich.certificate_keys(F.expr(TEXT)), ",").alias("certificates")).dropDuplicates(["id"])


_NAMES = "|".join(t.lower() for _, t, _ in terms(LANGUAGES))
_KEYS = "CASE hit " + " ".join(f"WHEN '{t.lower()}' THEN '{k}'" for k, t, _ in terms(LANGUAGES)) + " END"
_ORDER = "CASE k " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(LANGUAGES)) + " END"


@query(
    rf"""WITH x AS (SELECT id, lower({TITLE}) AS ti, lower({TEXT}) AS t FROM {POSTINGS}),
h AS (SELECT id, ti, t, regexp_extract_all(t, '\b({_NAMES})\b', 1) AS hits, string_split_regex(t, '\b({_NAMES})\b') AS ps FROM x),
m AS (SELECT id, ti, t, hits[i] AS hit, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda p: length(p))), 0))::INT AS st
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
j AS (SELECT id, ti, {_KEYS} AS k, t[greatest(0, st - 220) + 1 : st + length(hit)] AS near,
  regexp_extract(t[1:st], '[^.;\n]*$') || hit || regexp_extract(t[st + length(hit) + 1 :], '^[^.;\n]*') AS sentence FROM m),
said AS (SELECT id, {_KEYS} AS k FROM (SELECT id, unnest(regexp_extract_all(ti, '\b({_NAMES})[\s-]*speaking', 1)) AS hit FROM x)),
judged AS (SELECT id, k, CASE WHEN regexp_matches(near, '{enrich.ENUMERATION}') THEN 'no' WHEN regexp_matches(sentence, '{enrich.PREFERENCE}') THEN 'preferred'
  WHEN regexp_matches(sentence, '{enrich.REQUIREMENT}') THEN 'required' ELSE 'no' END AS how FROM j WHERE (id, k) NOT IN (SELECT id, k FROM said)),
req AS (SELECT DISTINCT id, k FROM (SELECT id, k FROM said UNION ALL SELECT id, k FROM judged WHERE how = 'required')),
pre AS (SELECT DISTINCT id, k FROM judged WHERE how = 'preferred' AND (id, k) NOT IN (SELECT id, k FROM req)),
r AS (SELECT id, string_agg(k, ',' ORDER BY {_ORDER}) AS required FROM req GROUP BY id),
p AS (SELECT id, string_agg(k, ',' ORDER BY {_ORDER}) AS preferred FROM pre GROUP BY id)
SELECT id, required, preferred FROM x LEFT JOIN r USING (id) LEFT JOIN p USING (id)"""
)
def en7_languages(spark: SparkSession, d: str) -> DataFrame:
    """EN7, ST4, FN11: languages required and preferred, judged by the sentence of each mention."""
    rows = spread(table(spark, d, "normalized_opportunities")).select("id", F.expr(TITLE).alias("title"), F.expr(TEXT).alias("text"))
    rows = enrich.with_languages(rows, F.col("title"), F.col("text"))
    return rows.select("id", F.array_join("required", ",").alias("required"), F.array_join("preferred", ",").alias("preferred")).dropDuplicates(["id"])


_UNIT = r"(\d{1,2}\+? (?:years?|months?|лет|год(?:а|ов)?|месяц(?:а|ев)?))(?:[^\p{L}\p{N}_]|$)"


@query(
    rf"""WITH x AS (SELECT id, lower({TEXT}) AS t FROM {POSTINGS}),
h AS (SELECT id, t, regexp_extract_all(t, '\b{_UNIT}', 0) AS whole, regexp_extract_all(t, '\b{_UNIT}', 1) AS hits, string_split_regex(t, '\b{_UNIT}') AS ps FROM x),
m AS (SELECT id, t, hits[i] AS hit, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda p: length(p))), 0))::INT AS st
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
y AS (SELECT id, max(regexp_extract(hit, '^\d+')::INT / CASE WHEN regexp_matches(hit, 'month|месяц') THEN 12.0 ELSE 1.0 END) AS years FROM m
  WHERE regexp_matches(t[greatest(0, st - 60) + 1 : st + length(hit) + 60], '{enrich.EXPERIENCE_WORDS}')
    AND NOT regexp_matches(t[greatest(0, st - 30) + 1 : st + length(hit) + 30], '{enrich.DURATION_WORDS}') GROUP BY id)
SELECT id, CASE WHEN regexp_matches(t, '{enrich.NO_EXPERIENCE}') THEN 'entry' WHEN years >= 5 THEN 'senior' WHEN years >= 2 THEN 'mid' WHEN years IS NOT NULL THEN 'junior' END AS level
FROM x LEFT JOIN y USING (id)"""
)
def en8_experience(spark: SparkSession, d: str) -> DataFrame:
    """EN8, AG12, FN12, FN20: level by the longest tenure asked for."""
    rows = spread(table(spark, d, "normalized_opportunities")).select("id", F.expr(TEXT).alias("text"))
    return enrich.with_experience(rows, F.col("text")).select("id", F.col("experience_level.value").alias("level")).dropDuplicates(["id"])


_SIGN_CODES = "CASE sign " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in enrich.SIGNS.items()) + " END"
_SIGN_LIST = ", ".join(f"'{x}'" for x in ("", *enrich.SIGNS, *enrich.UNKNOWN_SIGNS))


@query(
    f"""WITH x AS (SELECT id, trim(regexp_replace(salary_raw, '\\s+', ' ', 'g')) AS s FROM {POSTINGS} WHERE salary_raw IS NOT NULL),
halves AS (SELECT id, string_split(s, '/') AS h FROM x), sided AS (SELECT id, lower(trim(h[2])) AS per, list_transform(string_split(h[1], '-'), lambda b: trim(b)) AS bs FROM halves WHERE len(h) = 2),
cut AS (SELECT id, per, list_transform(bs, lambda b: regexp_extract(b, '[0-9][0-9,]*([.][0-9][0-9])?', 0)) AS ns, bs FROM sided WHERE len(bs) <= 2),
parts AS (SELECT id, per, ns, list_transform(bs, lambda b, i: upper(trim(b[1 : strpos(b, ns[i]) - 1]))) AS pre, list_transform(bs, lambda b, i: trim(b[strpos(b, ns[i]) + length(ns[i]) :])) AS post FROM cut WHERE NOT list_contains(ns, '')),
a AS (SELECT id, ns, per, coalesce(nullif(pre[1], ''), nullif(post[1], '')) AS sign FROM parts WHERE len(list_filter(pre, lambda p: p NOT IN ({_SIGN_LIST}))) = 0 AND len(list_filter(post, lambda p: p NOT IN ('', '$'))) = 0),
b AS (SELECT id, lower(s) LIKE 'up to %' AS upto, lower(s) LIKE '% per day' AS daily, regexp_replace(regexp_replace(lower(s), '^up to ', ''), ' per day$', '') AS core FROM x),
c AS (SELECT id, upto, daily, upper(core[-3:]) AS currency, string_split(core[:-5], ' - ') AS ns FROM b WHERE core[-4] = ' '),
num AS (SELECT * FROM c WHERE currency IN ('USD', 'EUR', 'GBP') AND len(ns) <= 2 AND NOT (upto AND len(ns) = 2) AND len(list_filter(ns, lambda n: NOT regexp_full_match(n, '[0-9]+( [0-9][0-9][0-9])*'))) = 0)
SELECT id, replace(ns[1], ',', '')::DECIMAL(18,2) AS minimum, replace(ns[len(ns)], ',', '')::DECIMAL(18,2) AS maximum, {_SIGN_CODES} AS currency, CASE per WHEN 'monthly' THEN 'month' WHEN 'weekly' THEN 'week' WHEN 'hourly' THEN 'hour' ELSE 'day' END AS period
FROM a WHERE {_SIGN_CODES} IS NOT NULL AND per IN ('monthly', 'weekly', 'hourly', 'daily')
UNION ALL SELECT id, CASE WHEN NOT upto THEN replace(ns[1], ' ', '')::DECIMAL(18,2) END, replace(ns[len(ns)], ' ', '')::DECIMAL(18,2), currency, CASE WHEN daily THEN 'day' ELSE 'month' END FROM num"""
)
def en9_salary(spark: SparkSession, d: str) -> DataFrame:
    """EN9, EN10, FN19: the two regular pay notations."""
    rows = spread(table(spark, d, "normalized_opportunities")).select("id", enrich.salary(F.col("salary_raw")).alias("s")).where("s is not null")
    return rows.select("id", "s.minimum", "s.maximum", "s.currency", "s.period").dropDuplicates(["id"])


_FIELD = "nullif(map_extract_value(source_fields, '{0}'), '')"
_QUALIFIED = f"coalesce(nullif(concat_ws(chr(10), {_FIELD.format('skills_knowledge_expertise')}, {_FIELD.format('additional_requirements')}), ''), description, '')"


def _over_qualified(name: str) -> str:
    """A rule's SQL over the text that states requirements instead of the description."""
    return "(" + SQL[name].replace(TEXT, _QUALIFIED) + ")"


@query(
    f"""SELECT n.id, a.profession, a.confidence AS profession_confidence, b.direction, b.workplace, c.country, coalesce(e.country, e.unresolved, CASE WHEN e.anywhere THEN 'anywhere' END) AS hires, f.certificates, g.required, g.preferred, h.level, s.currency, s.maximum
FROM {POSTINGS} n JOIN ({SQL["en1_profession"]}) a USING (id) JOIN ({SQL["en2_source_config"]}) b USING (id) JOIN ({SQL["en3_country"]}) c USING (id) LEFT JOIN ({SQL["en5_hiring_scope"]}) e USING (id)
JOIN {_over_qualified("en6_certificates")} f USING (id) JOIN {_over_qualified("en7_languages")} g USING (id) JOIN {_over_qualified("en8_experience")} h USING (id) LEFT JOIN ({SQL["en9_salary"]}) s USING (id)"""
)
def en14_enriched(spark: SparkSession, d: str) -> DataFrame:
    """EN4, EN14, PR14: all rule fields of every posting."""
    out = enrich.enrich(once(spark, d, "normalized_opportunities"), table(spark, d, "source_registry"))
    scope = F.col("hiring_scope")
    return out.select(
        "id", F.col("profession.value").alias("profession"), F.col("profession.confidence").alias("profession_confidence"), F.col("direction.value").alias("direction"), F.col("workplace_type_hint.value").alias("workplace"), F.col("country.value").alias("country"),
        F.coalesce(F.get(scope["countries"], F.lit(0)), F.get(scope["unresolved"], F.lit(0)), F.when(scope["anywhere"], "anywhere")).alias("hires"),
        F.array_join("required_certificates.value", ",").alias("certificates"), F.array_join("required_languages.value", ",").alias("required"), F.array_join("preferred_languages.value", ",").alias("preferred"), F.col("experience_level.value").alias("level"), F.col("salary.currency").alias("currency"), F.col("salary.maximum").alias("maximum"),
    )


@query(
    f"""SELECT n.id, '{{"profession":' || CASE WHEN a.profession IS NULL THEN 'null' ELSE '{{"value":"' || a.profession || '","provenance":"rule","confidence":' || a.confidence::VARCHAR || ',"quotes":null}}' END
|| ',"experience_level":' || CASE WHEN h.level IS NULL THEN 'null' ELSE '{{"value":"' || h.level || '","provenance":"rule","confidence":' || CASE WHEN h.level = 'entry' THEN '0.95' ELSE '0.9' END || ',"quotes":null}}' END || ',"city":null}}' AS enriched
FROM {POSTINGS} n JOIN ({SQL["en1_profession"]}) a USING (id) JOIN {_over_qualified("en8_experience")} h USING (id)"""
)
def pr15_stored_document(spark: SparkSession, d: str) -> DataFrame:
    """PR15: derived fields as the JSON document they are stored as, unknown ones written out as null (three of them here)."""
    out = enrich.enrich(once(spark, d, "normalized_opportunities"), table(spark, d, "source_registry"))
    return out.select("id", enrich.document(("profession", "experience_level", "city")).alias("enriched"))


@query(f"SELECT id, sha256(payload) AS content_hash, lower(r.content_hash) = sha256(payload) AS agrees FROM {RAW} r WHERE payload IS NOT NULL")
def fn2_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """FN2: SHA-256 of each payload, and whether the delivered hash is it."""
    return once(spark, d, "raw_items").where("payload is not null").select("id", fn.content_hash(F.col("payload")).alias("content_hash"), (F.lower("content_hash") == fn.content_hash(F.col("payload"))).alias("agrees"))


@query()
def fn1_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """FN1: payloads as canonical JSON, null where they aren't JSON."""
    return once(spark, d, "raw_items").select("id", fn.canonical_json(F.col("payload")).alias("canonical"))


_HTML = "('<html><body><h1>' || title || '</h1><!-- x --><script>var a=1;</script><p>' || replace(coalesce(description, ''), chr(10), '</p><p>') || '&amp; more&nbsp;</p></body></html>')"
_TAGS = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"


@query(
    f"""SELECT id, nullif(array_to_string(list_filter(list_transform(string_split_regex(replace(replace({_TAGS}, '&nbsp;', chr(160)), '&amp;', '&'), '\\r\\n|\\r|\\n'),
lambda x: trim(regexp_replace(x, '[\\s\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS text FROM (SELECT id, {_HTML} AS html FROM {POSTINGS} WHERE title IS NOT NULL)"""
)
def fn3_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """FN3, FN4: markup made of title and description back to lines."""
    return spread(table(spark, d, "normalized_opportunities")).where("title is not null").select("id", fn.html_to_text(F.expr(_HTML)).alias("text")).dropDuplicates(["id"])


@query(f"SELECT id, trim(regexp_replace(translate(description, '‘’“”', '''''\"\"'), '[\\s\\x{{A0}}]+', ' ', 'g')) AS text FROM {POSTINGS}")
def fn6_plain_spaces(spark: SparkSession, d: str) -> DataFrame:
    """FN6: white space and quote signs made plain."""
    return spread(table(spark, d, "normalized_opportunities")).select("id", fn.plain_spaces(F.col("description")).alias("text")).dropDuplicates(["id"])


@query(f"SELECT id, coalesce(contains(trim(regexp_replace(description, '[\\s\\x{{A0}}]+', ' ', 'g')), trim(regexp_replace(title, '[\\s\\x{{A0}}]+', ' ', 'g'))), false) AS held FROM {POSTINGS}")
def fn7_quote_held(spark: SparkSession, d: str) -> DataFrame:
    """FN7: whether a description holds the title as a quote."""
    return spread(table(spark, d, "normalized_opportunities")).select("id", fn.quote_in(F.col("description"), F.col("title")).alias("held")).dropDuplicates(["id"])


@query(f"SELECT id, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) AS host FROM {POSTINGS} WHERE regexp_matches(url, '^https?://[^/?#]+')")
def fn15_url_parts(spark: SparkSession, d: str) -> DataFrame:
    """FN15: scheme and host of each valid link."""
    u = F.col("url")
    return spread(table(spark, d, "normalized_opportunities")).where(u.rlike("^https?://[^/?#]+")).select("id", fn.scheme(u).alias("scheme"), fn.host(u).alias("host")).dropDuplicates(["id"])


@query(f"SELECT id, epoch_us(date_trunc('second', posted_at)) AS parsed_us FROM {POSTINGS} WHERE posted_at IS NOT NULL")
def fn16_feed_dates(spark: SparkSession, d: str) -> DataFrame:
    """FN16: feed dates written and read back."""
    written = F.date_format("posted_at", "EEE, d MMM yyyy HH:mm:ss Z")
    return spread(table(spark, d, "normalized_opportunities")).where("posted_at is not null").select("id", F.unix_micros(fn.rfc822(written)).alias("parsed_us")).dropDuplicates(["id"])


_STOP = ", ".join(f"{{'n': len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in words.split())}))), 'rank': {-i}, 'lang': '{lang}'}}" for i, (lang, words) in enumerate(fn.STOP_WORDS.items()))


@query(
    f"""SELECT id, CASE WHEN b.n >= 2 THEN b.lang END AS language FROM (SELECT id, list_sort([{_STOP}])[-1] AS b FROM (SELECT id, string_split_regex(lower(description), '[^\\p{{L}}]+') AS ws FROM {POSTINGS} WHERE description IS NOT NULL))"""
)
def fn21_rough_language(spark: SparkSession, d: str) -> DataFrame:
    """FN21: a first guess of the language by short words."""
    return spread(table(spark, d, "normalized_opportunities")).where("description is not null").select("id", fn.rough_language(F.col("description")).alias("language")).dropDuplicates(["id"])


@query(
    f"""SELECT id, CASE WHEN e AND c THEN 'both' WHEN e THEN 'experience' WHEN c THEN 'certificates' ELSE 'no-signal' END AS stratum FROM (
SELECT id, regexp_matches(t, 'experience|опыт|стаж|плавценз') AS e, regexp_matches(t, 'certificat|licen[cs]e|stcw|passport|visa|сертификат|диплом|паспорт|виза') AS c FROM (SELECT id, lower({TEXT}) AS t FROM {POSTINGS}))"""
)
def fn29_stratum(spark: SparkSession, d: str) -> DataFrame:
    """FN29: which requirement hints a text holds."""
    return spread(table(spark, d, "normalized_opportunities")).select("id", fn.stratum(F.expr(TEXT)).alias("stratum")).dropDuplicates(["id"])


@query(
    f"""SELECT id, nullif(array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(location_raw), ',\\s*[Nn][Aa]\\s*$', ''), ','), lambda x: trim(x)), lambda x: x <> ''), ', '), '') AS place
FROM {POSTINGS} WHERE location_raw IS NOT NULL AND NOT contains(location_raw, '&') AND lower(trim(location_raw)) <> 'na'"""
)
def pr8_address(spark: SparkSession, d: str) -> DataFrame:
    """PR8: location segments tidied, a closing NA dropped."""
    rows = spread(table(spark, d, "normalized_opportunities")).where("location_raw is not null and not contains(location_raw, '&') and lower(trim(location_raw)) <> 'na'")
    return rows.select("id", fn.address(F.col("location_raw")).alias("place")).dropDuplicates(["id"])
