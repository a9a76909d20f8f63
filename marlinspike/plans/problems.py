"""Queries of the general data problems 1, 2 and 4 over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.operators.shred import FLEET, certificates, entity, shred
from marlinspike.operators.snapshots import LISTING_FIELDS, listing_changes
from marlinspike.operators.units import monthly_pay
from marlinspike.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return monthly_pay(*(table(spark, d, n) for n in ("normalized_opportunities", "opportunities", "source_registry", "currency_rates", "pay_periods")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return certificates(table(spark, d, "raw_items"))


_ENTITIES = {
    "p2_vessels": ("vessel", {"name": "name", "imo_like": "imo_like"}),
    "p2_rotations": ("rotation", {"embark": "embark", "weeks_on": "weeks.on", "weeks_off": "weeks.off"}),
    "p2_positions": ("position", {"rank": "rank", "pay_min": "pay.min", "pay_max": "pay.max", "pay_currency": "pay.currency"}),
}


def _entity(level: str, fields: dict[str, str]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Problem 2: one level's flat table; the numbers above a row name its parents."""
        return entity(shred(table(spark, d, "raw_items"), levels_only=True), level, fields).withColumnRenamed("doc", "raw_id").drop("node", "parent")

    return query


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return listing_changes(table(spark, d, "opportunity_snapshots"), table(spark, d, "snapshot_log")).drop("changed_fields")


def p4_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each field changed, by source and snapshot."""
    moved = listing_changes(table(spark, d, "opportunity_snapshots"), table(spark, d, "snapshot_log"))
    return moved.where("change_kind = 'changed'").select("snapshot_no", "source_id", F.explode("changed_fields").alias("field")).groupBy("snapshot_no", "source_id", "field").agg(F.count("*").alias("n"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, **{name: _entity(*how) for name, how in _ENTITIES.items()}, "p4_found": p4_found, "p4_changed_fields": p4_changed_fields}


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


def _nested_sql() -> str:
    """Records of all levels in SQL: node(id, depth, path, own, v), own where v is a record and not something between two levels."""
    label = "CASE depth " + " ".join(f"WHEN {i} THEN z[1] IN ({_words(ls)})" for i, ls in enumerate(FLEET.entities.values())) + " ELSE false END"
    decoded = lambda x: f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x}->>'$', '^\\s*[\\[{{]') AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END"
    keyed = f"len(json_keys(d)) > 0 AND NOT list_has_any(json_keys(d), [{_words(FLEET.fields)}]) AND len(list_filter(json_extract(d, '$.*'), lambda y: json_type(y) NOT IN ('OBJECT', 'NULL'))) = 0"
    items = f"CASE json_type(d) WHEN 'ARRAY' THEN json_extract(d, '$[*]') WHEN 'NULL' THEN [] WHEN 'OBJECT' THEN CASE WHEN {keyed} THEN json_extract(d, '$.*') ELSE [d] END ELSE [d] END"
    return f"""WITH RECURSIVE raw AS (SELECT id, any_value(payload) AS payload FROM raw_items GROUP BY id),
node(id, depth, path, own, v) AS (SELECT id, 0, []::INT[], false, payload::JSON FROM raw WHERE regexp_matches(payload, '^\\s*[\\[{{]') AND json_valid(payload)
UNION ALL SELECT id, c.d, c.p, c.o, c.v FROM (SELECT id, unnest(CASE json_type(v)
  WHEN 'ARRAY' THEN list_transform(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) IN ('OBJECT', 'ARRAY')), lambda x: {{'d': depth, 'p': path, 'o': false, 'v': x}})
  ELSE list_concat(list_transform(list_filter(list_zip(ks, vs), lambda z: NOT coalesce({label}, false) AND json_type(z[2]) IN ('OBJECT', 'ARRAY')), lambda z: {{'d': depth, 'p': path, 'o': false, 'v': z[2]}}),
    list_filter(list_transform(flatten(list_transform(list_transform(list_filter(list_zip(ks, vs), lambda z: {label}), lambda z: {decoded("z[2]")}), lambda d: {items})),
      lambda it, n: {{'d': depth + 1, 'p': list_append(path, n::INT), 'o': true, 'v': {decoded("it")}}}), lambda s: json_type(s.v) <> 'NULL')) END) AS c
  FROM (SELECT *, json_keys(v) AS ks, json_extract(v, '$.*') AS vs FROM node WHERE depth < 4 AND (json_type(v) = 'OBJECT' OR (json_type(v) = 'ARRAY' AND NOT own)))))
"""


def _entity_sql(level: str, fields: dict[str, str]) -> str:
    names = list(FLEET.entities)
    depth = names.index(level) + 1
    numbers = ", ".join(f"path[{i + 1}] AS {names[i]}_no" for i in range(depth))
    cell = lambda at: f"CASE WHEN json_type({at}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN ({at})->>'$' END"
    values = ", ".join(f"{cell('v' + ''.join(f'->{part!r}' for part in at.split('.')))} AS {name}" for name, at in fields.items())
    return f"{_nested_sql()} SELECT id AS raw_id, {numbers}, {values} FROM node WHERE own AND depth = {depth}"


_LATEST = """
WITH done AS (SELECT DISTINCT source_id, snapshot_no FROM snapshot_log WHERE is_complete),
pairs AS (SELECT source_id, snapshot_no AS cur, lag(snapshot_no) OVER (PARTITION BY source_id ORDER BY snapshot_no) AS prev FROM done),
latest AS (
  SELECT s.* FROM (
    SELECT snapshot_no, source_id, external_id, lower(content_hash) AS content_hash, status, first_seen_at,
           row_number() OVER (PARTITION BY snapshot_no, source_id, external_id
             ORDER BY loaded_at DESC, lower(content_hash) DESC, status DESC, first_seen_at DESC) AS rn
    FROM opportunity_snapshots) s SEMI JOIN done USING (source_id, snapshot_no) WHERE rn = 1),
cur AS (SELECT p.cur AS no, l.* FROM pairs p JOIN latest l ON l.source_id = p.source_id AND l.snapshot_no = p.cur WHERE p.prev IS NOT NULL),
prev AS (SELECT p.cur AS no, l.* FROM pairs p JOIN latest l ON l.source_id = p.source_id AND l.snapshot_no = p.prev),
both_sides AS (
  SELECT coalesce(c.no, p.no) AS snapshot_no, coalesce(c.source_id, p.source_id) AS source_id, coalesce(c.external_id, p.external_id) AS external_id,
    p.no IS NULL AS is_new, c.no IS NULL AS is_gone,
    c.content_hash IS DISTINCT FROM p.content_hash AS h, c.status IS DISTINCT FROM p.status AS s, c.first_seen_at IS DISTINCT FROM p.first_seen_at AS f
  FROM cur c FULL JOIN prev p ON c.no = p.no AND c.source_id = p.source_id AND c.external_id IS NOT DISTINCT FROM p.external_id)
"""

SQL = {
    "p2_found": _nested_sql()
    + """, cert AS (SELECT id, path, CASE WHEN json_type(v) = 'OBJECT' THEN v->'code' ELSE v END AS code FROM node WHERE own AND depth = 4)
SELECT id AS raw_id, path[1] AS vessel_no, path[2] AS rotation_no, path[3] AS position_no, path[4] AS cert_no, code->>'$' AS cert_code FROM cert WHERE json_type(code) NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    **{name: _entity_sql(*how) for name, how in _ENTITIES.items()},
    "p4_found": _LATEST
    + """SELECT snapshot_no, source_id, external_id, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'changed' END AS change_kind
FROM both_sides WHERE is_new OR is_gone OR h OR s OR f""",
    "p4_changed_fields": _LATEST
    + "".join(
        f"""{joiner}SELECT snapshot_no, source_id, '{name}' AS field, count(*) AS n FROM both_sides
WHERE NOT is_new AND NOT is_gone AND {flag} GROUP BY snapshot_no, source_id"""
        for joiner, name, flag in zip(["", " UNION ALL ", " UNION ALL "], LISTING_FIELDS, "hsf")
    ),
}
