"""Queries of the reports, the evaluation and the sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions import text as fn
from marlinspike.operators import enrich, reports
from marlinspike.plans.common import POSTINGS, RAW, TEXT, STORED, once
from marlinspike.plans.rules import SQL as RULES
from marlinspike.session import scratch_folder, table
from marlinspike.sources import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _posted(spark: SparkSession, d: str) -> DataFrame:
    texts = once(spark, d, "normalized_opportunities").select("id", "title", "description", "location_raw", "salary_raw")
    return once(spark, d, "opportunities").join(texts, "id")


_PLAIN = ("title", "description", "employer", "location_raw", "salary_raw")
_FILLED = ", ".join(f"count(*) FILTER (status = 'active' AND {f} IS NOT NULL AND {f} <> '') AS filled_{f}" for f in _PLAIN)
_JOINED = f"(SELECT o.*, n.title, n.description, n.location_raw, n.salary_raw FROM {STORED} o JOIN {POSTINGS} n USING (id))"


@query(
    f"""SELECT source_id, source_trust, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'rejected') AS rejected, {_FILLED},
count(*) FILTER (status = 'active' AND salary IS NOT NULL) AS filled_salary FROM {_JOINED} GROUP BY source_id, source_trust"""
)
def ag2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """AG2, AG3, AG4: totals and fill rates by source and trust."""
    return reports.coverage(_posted(spark, d), _PLAIN, ("salary",))


@query(f"SELECT source_id, 'salary' AS field, salary.provenance AS provenance, count(*) AS n FROM {STORED} WHERE status = 'active' AND salary.value IS NOT NULL GROUP BY ALL")
def ag4_provenance(spark: SparkSession, d: str) -> DataFrame:
    """AG4: where derived values come from."""
    return reports.provenance_histogram(once(spark, d, "opportunities"), ["salary"])


@query(f"SELECT source_id, flag, count(*) AS n FROM (SELECT source_id, unnest(quality_flags) AS flag FROM {STORED} WHERE status = 'rejected') GROUP BY ALL")
def ag5_rejections(spark: SparkSession, d: str) -> DataFrame:
    """AG5: reasons of rejection."""
    return reports.rejection_reasons(once(spark, d, "opportunities"))


# Gold and predicted levels: both by id, so that every outcome occurs; the quote is the title.
_GOLD = "CASE id % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' END"
_PRED = "CASE WHEN id % 6 = 0 THEN 'entry' WHEN id % 6 <= 3 THEN 'mid' WHEN id % 6 = 4 THEN 'senior' END"
_BASIS = "CASE WHEN id % 2 = 0 THEN 'stated' ELSE 'inferred' END"
_GOLD_CERTS = "CASE id % 3 WHEN 0 THEN array('stcw','coc') WHEN 1 THEN array('gmdss') END"
_PRED_CERTS = "CASE WHEN id % 5 <= 1 THEN array('coc','stcw') WHEN id % 5 = 2 THEN array('gmdss','gmdss') END"
_EVAL = f"""(SELECT id, source_id, external_id, {_GOLD} AS gold, {_PRED} AS pred, {_BASIS} AS basis, coalesce(contains(trim(regexp_replace(description, '[\\s\\x{{A0}}]+', ' ', 'g')), trim(regexp_replace(title, '[\\s\\x{{A0}}]+', ' ', 'g'))), false) AS ok,
  {_GOLD_CERTS.replace("array(", "list_value(")} AS gc, {_PRED_CERTS.replace("array(", "list_value(")} AS pc, id % 7 AS run FROM {POSTINGS})"""


def _eval(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "normalized_opportunities").selectExpr("id", "source_id", "external_id", "title", "description", f"{_GOLD} AS gold", f"{_PRED} AS pred", f"{_BASIS} AS basis", f"{_GOLD_CERTS} AS gc", f"{_PRED_CERTS} AS pc", "id % 7 AS run")


_RATES = """count(*) AS rows, round(count(*) FILTER (pred IS NOT NULL AND pred IS NOT DISTINCT FROM gold) / nullif(count(*) FILTER (pred IS NOT NULL), 0), 6) AS precision,
round(count(*) FILTER (pred IS NOT NULL AND pred IS NOT DISTINCT FROM gold) / nullif(count(*) FILTER (gold IS NOT NULL), 0), 6) AS recall,
round(count(*) FILTER (pred IS NOT NULL AND gold IS NULL) / count(*), 6) AS false_fill_rate, round(count(*) FILTER (pred IS NOT NULL AND NOT ok) / nullif(count(*) FILTER (pred IS NOT NULL), 0), 6) AS invalid_quote_rate"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT 'all' AS part, {_RATES} FROM {_EVAL} UNION ALL SELECT 'inferred' AS part, {_RATES} FROM {_EVAL} WHERE basis = 'inferred'")
def ag6_extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG6, AG8, JN11: precision, recall, false fills and invalid quotes, over all and over a stratum."""
    rows = _eval(spark, d).withColumn("part", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("basis") == "inferred", "inferred")))))
    return _rounded(reports.extraction_metrics(rows, F.col("gold"), F.col("pred"), F.col("title"), F.col("description"), by=["part"]))


_P, _G = "list_sort(list_distinct(coalesce(pc, [])))", "list_sort(list_distinct(coalesce(gc, [])))"


@query(
    f"""SELECT source_id, count(*) AS rows, round(count(*) FILTER (len({_P}) > 0 AND {_P} = {_G}) / nullif(count(*) FILTER (len({_P}) > 0), 0), 6) AS precision,
round(count(*) FILTER (len({_P}) > 0 AND {_P} = {_G}) / nullif(count(*) FILTER (len({_G}) > 0), 0), 6) AS recall, round(count(*) FILTER (len({_P}) > 0 AND len({_G}) = 0) / count(*), 6) AS false_fill_rate FROM {_EVAL} GROUP BY source_id"""
)
def ag6_list_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG6, ST3: the same for lists compared as sets, by source."""
    return _rounded(reports.list_metrics(_eval(spark, d), F.col("gc"), F.col("pc"), by=["source_id"]))


@query(f"SELECT basis, count(*) AS n FROM {_EVAL} WHERE pred IS NOT NULL GROUP BY basis")
def ag7_by_basis(spark: SparkSession, d: str) -> DataFrame:
    """AG7: predictions by basis."""
    return _eval(spark, d).where("pred is not null").groupBy("basis").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT run, {_RATES} FROM {_EVAL} GROUP BY run) SELECT 'experience' AS field, metric, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM (
SELECT 'precision' AS metric, precision AS v FROM r UNION ALL SELECT 'recall', recall FROM r UNION ALL SELECT 'false_fill_rate', false_fill_rate FROM r) GROUP BY metric"""
)
def ag9_spread(spark: SparkSession, d: str) -> DataFrame:
    """AG9: spread of the metrics over runs."""
    runs = _rounded(reports.extraction_metrics(_eval(spark, d), F.col("gold"), F.col("pred"), F.col("title"), F.col("description"), by=["run"])).withColumn("field", F.lit("experience"))
    return _rounded(reports.spread(runs, ["precision", "recall", "false_fill_rate"]))


_KINDS = "list_filter([CASE WHEN pred IS NOT NULL AND gold IS NULL THEN 'false_fill' WHEN pred IS NOT NULL AND gold <> pred THEN 'wrong_value' END, CASE WHEN pred IS NOT NULL AND NOT ok THEN 'invalid_quote' END], lambda x: x IS NOT NULL)"


@query(f"SELECT 'experience' AS field, kind, count(*) AS n FROM (SELECT unnest({_KINDS}) AS kind FROM {_EVAL}) GROUP BY kind")
def ag10_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """AG10, SO3: disagreements tallied by field and kind."""
    found = reports.disagreements(_eval(spark, d), "external_id", F.col("gold"), F.col("pred"), F.col("title"), F.col("description"), "experience")
    return found.groupBy("field", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT source_id, count(DISTINCT external_id) AS postings, count(*) AS versions, sum(length(payload)) AS chars FROM {RAW} GROUP BY source_id")
def ag16_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG16, AG18: distinct postings, versions and volume by source."""
    return once(spark, d, "raw_items").groupBy("source_id").agg(F.count_distinct("external_id").alias("postings"), F.count("*").alias("versions"), F.sum(F.length("payload")).alias("chars"))


@query(f"SELECT source_id, sum(len(quality_flags))::BIGINT AS flags, sum(len(quality_notes))::BIGINT AS notes FROM {STORED} GROUP BY source_id")
def ag17_list_lengths(spark: SparkSession, d: str) -> DataFrame:
    """AG17: total lengths of list fields by source."""
    return once(spark, d, "opportunities").groupBy("source_id").agg(F.sum(F.size("quality_flags")).alias("flags"), F.sum(F.size("quality_notes")).alias("notes"))


_READ_KEYS = ("id", "url", "title", "location", "job", "compensation", "name", "description", "employment_type", "division", "department", "structure_custom_group_one", "item", "link", "guid", "pubDate", "salary", "category", "sector", "employer")
_EXPECTED_KEYS = ("revision", "contacts")
_LABELS = r'''"([A-Za-z_][A-Za-z0-9_]*)" *:|<([A-Za-z][A-Za-z0-9_]*)[ />]'''


@query(
    f"""WITH p AS (SELECT source_id, payload FROM {RAW} WHERE regexp_matches(payload, '^\\s*[\\[{{<]')),
k AS (SELECT source_id, list_distinct(list_concat(regexp_extract_all(payload, '{_LABELS}', 1), regexp_extract_all(payload, '{_LABELS}', 2))) AS present FROM p)
SELECT source_id, key, count(*) AS n, key IN {_EXPECTED_KEYS} AS expected FROM (SELECT source_id, unnest(present) AS key FROM k) WHERE key <> '' AND key NOT IN {_READ_KEYS} GROUP BY source_id, key"""
)
def ag14_lost_keys(spark: SparkSession, d: str) -> DataFrame:
    """AG14, ST6, SO6: labels at any depth of JSON and RSS payloads that normalization doesn't read, most frequent first."""
    raw = once(spark, d, "raw_items").where(F.col("payload").rlike(r"^\s*[\[{<]"))
    found = [F.regexp_extract_all("payload", F.lit(_LABELS), F.lit(i)) for i in (1, 2)]
    rows = raw.select("source_id", F.filter(F.array_distinct(F.concat(*found)), lambda k: k != "").alias("present"))
    return reports.lost_keys(rows, F.col("present"), F.array(*[F.lit(k) for k in _READ_KEYS]), expected=_EXPECTED_KEYS, by=["source_id"])


@query()
def ag14_lost_certificates(spark: SparkSession, d: str) -> DataFrame:
    """AG14: certificates that a posting's whole payload names and the text that the rules read doesn't, JSON and RSS."""
    raw = once(spark, d, "raw_items")
    read = feeds.normalize(raw).select("id", enrich.qualification_text(F.col("source_fields"), F.col("description")).alias("readable"))
    return reports.lost_certificates(raw.join(read, "id"), F.col("payload"), F.col("readable"), by=["source_id"])


_GV = f"""(SELECT external_id, description AS text, {_PRED} AS level, CASE WHEN id % 8 <> 0 THEN {_BASIS} END AS level_basis, CASE WHEN id % 3 = 0 THEN substring(description, 1, 20) WHEN id % 3 = 1 THEN 'not there at all' END AS level_quote FROM {POSTINGS})"""
_OK = "coalesce(contains(trim(regexp_replace(translate(text, '‘’“”', '''''\"\"'), '[\\s\\x{A0}]+', ' ', 'g')), trim(regexp_replace(translate(level_quote, '‘’“”', '''''\"\"'), '[\\s\\x{A0}]+', ' ', 'g'))), false)"


@query(
    f"""SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN level IS NOT NULL AND level_basis IS NULL THEN 'basis_unknown' END, CASE WHEN level IS NULL AND level_quote IS NOT NULL THEN 'quote_without_level' END,
CASE WHEN level IS NOT NULL AND level_quote IS NULL THEN 'level_without_quote' END, CASE WHEN level_quote IS NOT NULL AND NOT {_OK} THEN 'quote_not_in_text' END], lambda x: x IS NOT NULL)) AS rule FROM {_GV}) GROUP BY rule"""
)
def pr20_gold_rules(spark: SparkSession, d: str) -> DataFrame:
    """PR20, AG15: broken rules of labelled records, counted."""
    quote = "CASE WHEN id % 3 = 0 THEN substring(description, 1, 20) WHEN id % 3 = 1 THEN 'not there at all' END"
    gold = once(spark, d, "normalized_opportunities").selectExpr("external_id", "description AS text", f"{_PRED} AS level", f"CASE WHEN id % 8 <> 0 THEN {_BASIS} END AS level_basis", f"{quote} AS level_quote", "cast(null as array<struct<key:string,quote:string>>) AS certificates")
    return reports.gold_violations(gold).groupBy("rule").agg(F.count("*").alias("n"))


_POOL = f"""(SELECT n.id, n.source_id, md5(n.id::VARCHAR || '|20260720') AS o FROM {POSTINGS} n JOIN ({RULES["en6_certificates"]}) c USING (id) JOIN ({RULES["en8_experience"]}) l USING (id)
WHERE length(trim(coalesce(description, ''))) >= 20 AND (certificates IS NULL OR level IS NULL))"""


@query(f"SELECT id, source_id FROM {_POOL} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY o, id) <= 5")
def so7_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """SO7, PR18: a seeded sample of five postings of each source in which the rules left a gap (a sampling operator: the limit is the feature)."""
    rows = enrich.with_experience(once(spark, d, "normalized_opportunities").select("id", "source_id", F.expr(TEXT).alias("text")), F.col("text"))
    pool = reports.sampling_pool(rows.withColumn("required_certificates", enrich.certificate_keys(F.col("text")))).select("id", "source_id")
    sources = [r[0] for r in table(spark, d, "source_registry").select("source_id").distinct().limit(10_000).collect()]
    return reports.stratified_sample(pool, "source_id", "id", dict.fromkeys(sources, 5), 20260720)


@query(
    f"""SELECT id FROM (SELECT id, {TEXT} AS t FROM {POSTINGS}) JOIN ({RULES["en6_certificates"]}) c USING (id) JOIN ({RULES["en8_experience"]}) l USING (id)
WHERE (certificates IS NULL OR level IS NULL) AND length(regexp_replace(trim(regexp_replace(t, '[\\s\\x{{A0}}]+', ' ', 'g')), '\\s', '', 'g')) >= 20"""
)
def pr17_needs_model(spark: SparkSession, d: str) -> DataFrame:
    """PR17: postings that a model would be asked about."""
    from marlinspike.operators import completion

    rows = enrich.with_experience(once(spark, d, "normalized_opportunities").select("id", F.expr(TEXT).alias("text")), F.col("text"))
    return completion.needs_completion(rows.withColumn("required_certificates", enrich.certificate_keys(F.col("text")))).select("id")


_TENURE_SQL, _CERTS_SQL = RULES["en8_experience"], RULES["en6_certificates"]
_SPACED = """trim(regexp_replace(translate({0}, '‘’“”', '''''""'), '[\\s\\x{{A0}}]+', ' ', 'g'))"""


@query(
    f"""WITH l AS ({_TENURE_SQL}), c AS ({_CERTS_SQL}), x AS (SELECT id, {TEXT} AS t, lower({TEXT}) AS low FROM {POSTINGS}),
a AS (SELECT id, level, certificates, low, (level IS NULL OR certificates IS NULL) AND length(regexp_replace({_SPACED.format("t")}, '\\s', '', 'g')) >= 20 AS asked, contains({_SPACED.format("t")}, {_SPACED.format("t[1:30]")}) AS held, t FROM x JOIN l USING (id) JOIN c USING (id)),
m AS (SELECT *, asked AND level IS NULL AND held AND (contains(low, 'captain') OR contains(low, 'master')) AS filled FROM a)
SELECT id, coalesce(level, CASE WHEN filled THEN 'senior' END) AS value, CASE WHEN level IS NOT NULL THEN 'rule' WHEN filled THEN 'llm' END AS provenance, CASE WHEN filled THEN t[1:30] END AS quote, certificates FROM m"""
)
def en11_completed(spark: SparkSession, d: str) -> DataFrame:
    """EN11, EN12, EN13, SC15: null fields completed by a recorded client behind a stored cache, quotes verified and kept."""
    from marlinspike.operators import completion
    from marlinspike.operators.tables import ParquetTable

    rows = once(spark, d, "normalized_opportunities").select("id", F.expr(TEXT).alias("text"))
    rows = enrich.with_experience(rows, F.col("text")).withColumn("_c", enrich.certificate_keys(F.col("text"))).withColumn("required_certificates", enrich.inferred(F.col("_c"), 0.9)).drop("_c")
    cache = completion.refresh_cache(ParquetTable(spark, scratch_folder(spark, "cache")), rows, RecordedClient, "5", "recorded")
    out = completion.complete(rows, cache, "5", "recorded")
    level = F.col("experience_level")
    return out.select("id", level["value"].alias("value"), level["provenance"].alias("provenance"), F.try_element_at(level["quotes"], level["value"]).alias("quote"), F.array_join("required_certificates.value", ",").alias("certificates"))


class RecordedClient:
    """A client without a model: it answers by wording, wrongly at times, so that every check has work."""

    def extract(self, text: str) -> dict:
        low = text.lower()
        if "captain" in low or "master" in low:
            level = {"value": "senior", "quote": text[:30], "basis": "inferred"}
        elif "trainees" in low:
            level = {"value": "mid", "quote": "words that aren't there", "basis": "stated"}
        else:
            level = None
        certs = [{"key": "food_hygiene", "quote": "Food Hygiene course", "basis": "stated"}] if "food hygiene" in low else []
        return {"experience_level": level, "required_certificates": certs}


_ONE = "coalesce(payload->'$.data[0]', payload->'$.posting', payload::JSON)"


@query(
    f"""SELECT id, p->>'$.title' AS title, p->>'$.job.structure_custom_group_one.name' AS employer, nullif(trim(p->>'$.location.name'), '') AS office, nullif(trim(p->>'$.compensation'), '') AS salary_raw
FROM (SELECT id, {_ONE} AS p FROM {RAW} WHERE regexp_matches(payload, '^\\s*\\{{') AND json_valid(payload)) WHERE p->>'$.id' IS NOT NULL"""
)
def pr1_json_postings(spark: SparkSession, d: str) -> DataFrame:
    """PR1, FN22, FN23: the JSON postings' fields."""
    out = feeds.from_json_payload(once(spark, d, "raw_items"))
    return out.select("id", "title", "employer", F.col("recruitment_office_raw").alias("office"), "salary_raw")


_X = r"regexp_extract(payload, '(?s)<{0}>(.*?)</{0}>', 1)"


def _decoded(sql: str) -> str:
    """Entities of XML, and then of the markup in it, decoded in SQL."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        sql = f"replace({sql}, '{name}', '{sign}')"
    return sql


@query(
    f"""SELECT id, {_decoded(_decoded(f"trim({_X.format('title')})"))} AS title, nullif({_decoded(f"trim({_X.format('salary')})")}, '') AS salary_raw FROM {RAW} WHERE regexp_matches(payload, '(?s)^\\s*<item>.*</item>\\s*$')"""
)
def pr3_rss_postings(spark: SparkSession, d: str) -> DataFrame:
    """PR3, PR7: the RSS items' title and pay."""
    return feeds.from_rss_payload(once(spark, d, "raw_items")).select("id", "title", "salary_raw")


_XD = lambda tag: f"nullif({_decoded(f'trim({_X.format(tag)})')}, '')"
_PLACE = f"""nullif(array_to_string(list_filter(list_transform(string_split(regexp_replace(trim({_XD("location")}), ',\\s*[Nn][Aa]\\s*$', ''), ','), lambda x: trim(x)), lambda x: x <> ''), ', '), '')"""


@query(
    f"""SELECT id, source_id, coalesce(p->>'$.id', external_id) AS external_id, coalesce(p->>'$.url', url) AS url, nullif(trim(p->>'$.title'), '') AS title, nullif(trim(p->>'$.job.structure_custom_group_one.name'), '') AS employer, NULL AS location_raw,
  nullif(trim(p->>'$.location.name'), '') AS recruitment_office_raw, nullif(trim(p->>'$.compensation'), '') AS salary_raw
FROM (SELECT *, {_ONE} AS p FROM {RAW} WHERE regexp_matches(payload, '^\\s*\\{{') AND json_valid(payload)) WHERE p->>'$.id' IS NOT NULL
UNION ALL SELECT id, source_id, coalesce(nullif(regexp_extract({_X.format('guid')}, '/vacId/([0-9]+)', 1), ''), {_XD("RecuiterJobNumber")}, external_id), coalesce({_XD("link")}, url), {_decoded(_XD("title"))}, {_XD("employer")}, {_PLACE}, NULL, {_XD("salary")}
FROM {RAW} WHERE regexp_matches(payload, '(?s)^\\s*<item>.*</item>\\s*$')"""
)
def sc1_normalized(spark: SparkSession, d: str) -> DataFrame:
    """SC1, SC2, SC17, PR1-PR7: postings read from JSON and RSS payloads."""
    out = feeds.normalize(once(spark, d, "raw_items"))
    return out.select("id", "source_id", "external_id", "url", "title", "employer", "location_raw", "recruitment_office_raw", "salary_raw")


_OBJECT = f"(SELECT id, source_id, payload, regexp_matches(payload, '^\\s*[{{\\[]') AS is_json, CASE WHEN regexp_matches(payload, '^\\s*[{{\\[]') AND json_valid(payload) THEN {_ONE} END AS one FROM {RAW})"


@query(
    f"""SELECT source_id, error, count(*) AS n FROM (SELECT source_id, CASE WHEN payload IS NULL OR trim(payload) = '' THEN 'empty' WHEN is_json AND NOT json_valid(payload) THEN 'broken_json' WHEN is_json AND (one->>'$.id') IS NULL THEN 'no_posting'
WHEN regexp_matches(payload, '^\\s*<item>') AND NOT regexp_matches(payload, '(?s)</item>\\s*$') THEN 'broken_xml' WHEN NOT is_json AND NOT regexp_matches(payload, '^\\s*<item>') THEN 'foreign_form' END AS error FROM {_OBJECT}) WHERE error IS NOT NULL GROUP BY ALL"""
)
def pr_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """H4: payloads that can't be read, by source and reason."""
    return feeds.quarantine(once(spark, d, "raw_items")).groupBy("source_id", "error").agg(F.count("*").alias("n"))


_SHARES = ", ".join(f"'{f} ' || CASE WHEN active > 0 THEN printf('%.1f%%', round(filled_{f} * 100.0 / active, 1)) ELSE '—' END" for f in (*_PLAIN, "salary"))


@query(
    f"""SELECT source_trust, source_id, concat_ws('; ', printf('%s (%s): %d rows, %d active, %d rejected', source_id, source_trust, total, active, rejected), {_SHARES}) AS line FROM (
SELECT source_id, source_trust, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'rejected') AS rejected, {_FILLED}, count(*) FILTER (status = 'active' AND salary.value IS NOT NULL) AS filled_salary FROM {_JOINED} GROUP BY source_id, source_trust)"""
)
def sk10_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """SK10, FN26, SO2: the coverage report as text."""
    return reports.report_lines(reports.coverage(_posted(spark, d), _PLAIN, ("salary",)))


@query()
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """All stages over the raw table: latest versions, normalized, gated, classified, enriched, and their coverage."""
    from marlinspike.jobs import DERIVED, PLAIN, processed

    rows = processed(once(spark, d, "raw_items"), table(spark, d, "source_registry"))
    return reports.coverage(rows, PLAIN, DERIVED)
