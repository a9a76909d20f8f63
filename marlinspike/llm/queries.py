"""Queries of the llm problems over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.llm import boilerplate, canonical, languages, mixing, near_duplicates, packing, subjects
from marlinspike.llm.tokens import count_tokens
from marlinspike.session import table

#: Problem 3: postings are alike from half of their three-word runs on; 48 bands of 4 slots meet such a pair with probability 0.95, one at 0.6 with 0.999.
POSTINGS_ALIKE = {"width": 3, "threshold": 0.5, "bands": 48, "rows": 4}


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_opportunities")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_postings(spark, d), **POSTINGS_ALIKE)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_postings(spark, d), **POSTINGS_ALIKE)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(_postings(spark, d))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_boilerplate(_postings(spark, d))


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Size of each boilerplate block by source."""
    blocks = boilerplate.boilerplate_blocks(_postings(spark, d))
    return blocks.groupBy("source", "block").agg(F.count("*").alias("lines"), F.max("support").alias("support"), F.max("edge_support").alias("edge_support")).drop("block")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.language_errors(_postings(spark, d))


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every description's main language and every line in another one, with its confidence."""
    return languages.languages(_postings(spark, d)).select("id", "line_no", "lang", F.round("confidence", 4).alias("confidence"))


#: Fields of a posting, the list each is mapped to and how.
FREE_FIELDS = {"location_raw": ("places", "place"), "recruitment_office_raw": ("places", "place"), "title": ("professions", "title")}


def _lists(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"places": table(spark, d, "ref_places"), "professions": table(spark, d, "ref_professions")}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_values(_postings(spark, d), _lists(spark, d), FREE_FIELDS)


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_values(_postings(spark, d), _lists(spark, d), FREE_FIELDS)


def _packs(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    """Token counts, and the pack sizes (a small fixed table of parameters)."""
    packs = table(spark, d, "pack_sizes").where("pack_name is not null and capacity_tokens > 0").orderBy("capacity_tokens", "pack_name").limit(101).collect()
    return count_tokens(table(spark, d, "documents")), {r["pack_name"]: r["capacity_tokens"] for r in packs}


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(*_packs(spark, d)).withColumnRenamed("id", "doc_id")


def p8_unused(spark: SparkSession, d: str) -> DataFrame:
    """Unused space by pack size, and what the buckets' padding and batches inside buckets alone would leave."""
    sizes, packs = _packs(spark, d)
    plans = packing.plan_packs(sizes, packs)
    return packing.unused_space(packing.pack(sizes, packs, plans=plans), plans)


def _mixture(spark: SparkSession, d: str, exact: bool = False) -> DataFrame:
    """The mixture raked to source, language (by problem 5's operator) and topic (by problem 10's); texts are read in one pass."""
    documents = table(spark, d, "documents")
    shared = spark.sparkContext.broadcast((languages.train(documents, "text", "lang", id_column="doc_id").weights, _subject_model(spark, d)))
    features = {"lang": lambda texts: languages.main_languages(texts, shared.value[0]), "topic": lambda texts: [shared.value[1].topic(t) for t in texts]}
    return mixing.mix(count_tokens(documents, keep=("source",), features=features), table(spark, d, "mix_targets"), exact=exact)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares of the mixture, in which sources too small for their share fall short."""
    return mixing.shares(_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_shares_exact(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares of the largest mixture in which every source holds its share."""
    return mixing.shares(_mixture(spark, d, exact=True), table(spark, d, "mix_targets"))


def _subject_model(spark: SparkSession, d: str) -> subjects.SubjectModel:
    return subjects.fit(table(spark, d, "documents"), table(spark, d, "subject_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), _subject_model(spark, d))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), _subject_model(spark, d))


QUERIES = {
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p5_languages": p5_languages,
    "p6_found": p6_found,
    "p6_cleaned": p6_cleaned,
    "p6_blocks": p6_blocks,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
    "p8_containers": p8_containers,
    "p8_unused": p8_unused,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_shares_exact": p9_shares_exact,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_LINES = r"""
WITH once AS (SELECT DISTINCT id, source_id, description FROM normalized_opportunities),
cut AS (SELECT id, source_id, string_split(description, chr(10)) AS ls FROM once WHERE description IS NOT NULL),
ln AS (SELECT id, source_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM cut),
keyed AS (SELECT id, source_id, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM ln),
total AS (SELECT source_id, count(DISTINCT id) AS total FROM once GROUP BY source_id),
kept AS (SELECT source_id, k FROM keyed JOIN total USING (source_id) WHERE k <> '' GROUP BY source_id, k, total
         HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.03 * total),
found AS (SELECT DISTINCT id, line_no::INT AS line_no FROM keyed SEMI JOIN kept USING (source_id, k))
"""

# Words are runs of letters and digits; every text once, with its word runs of three, and the pairs of texts that share half of them.
_ALIKE = r"""
WITH RECURSIVE rec AS (SELECT DISTINCT id, title, description FROM normalized_opportunities WHERE id IS NOT NULL AND description IS NOT NULL),
txt AS (SELECT row_number() OVER () AS k, title, description, list(id) AS ids, min(id) AS least FROM rec GROUP BY title, description),
wds AS (SELECT k, regexp_extract_all(lower(coalesce(title || chr(10), '') || description), '[\p{L}\p{N}]+') AS ws FROM txt WHERE len(regexp_extract_all(description, '[\p{L}\p{N}]+')) >= 30),
sh AS (SELECT DISTINCT k, unnest(list_transform(range(1, greatest(1, len(ws) - 2) + 1), lambda i: array_to_string(ws[i : i + 2], ' '))) AS s FROM wds),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
shared AS (SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
alike AS (SELECT ka, kb FROM shared JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE 2 * c >= x.n + y.n - c)
"""

SQL = {
    "p3_found": _ALIKE
    + """, member AS (SELECT k, unnest(ids) AS id FROM txt)
SELECT least(p.id, q.id) AS id_a, greatest(p.id, q.id) AS id_b FROM alike JOIN member p ON p.k = ka JOIN member q ON q.k = kb
UNION ALL SELECT p.id, q.id FROM member p JOIN member q ON p.k = q.k AND p.id < q.id SEMI JOIN n ON n.k = p.k""",
    "p3_groups": _ALIKE
    + """, edge AS (SELECT ka AS a, kb AS b FROM alike UNION ALL SELECT kb, ka FROM alike),
reach(k, root) AS (SELECT k, k FROM txt UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.k),
class AS (SELECT r.k, min(t.least) AS class_id FROM reach r JOIN txt t ON t.k = r.root GROUP BY r.k),
links AS (SELECT a AS k, count(*) AS n FROM edge GROUP BY a)
SELECT unnest(ids) AS id, class_id, coalesce(l.n, 0) AS text_links, len(ids) AS copies FROM txt JOIN class USING (k) LEFT JOIN links l USING (k)""",
    "p6_found": _LINES + "SELECT id, line_no FROM found",
    "p6_cleaned": _LINES
    + """, gone AS (SELECT id, list(line_no) AS gone FROM found GROUP BY id)
SELECT o.id, o.source_id AS source, CASE WHEN gone IS NULL THEN description ELSE
  array_to_string([x FOR x, i IN string_split(description, chr(10)) IF NOT list_contains(gone, i::INT)], chr(10)) END AS text,
  coalesce(len(gone), 0)::INT AS removed_lines
FROM once o LEFT JOIN gone g ON o.id = g.id""",
    "p6_blocks": _LINES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, lettered AS (SELECT id, source_id, k, lead(k) OVER (PARTITION BY id ORDER BY line_no) AS n FROM keyed WHERE k <> ''),
strong AS (SELECT source_id, k, n, count(DISTINCT id) AS w FROM lettered JOIN total USING (source_id) WHERE k <> n GROUP BY source_id, k, n, total
           HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.03 * total),
links AS (SELECT source_id, k AS a, n AS b, w FROM strong UNION ALL SELECT source_id, n, k, w FROM strong),
reach(source_id, node, root) AS (SELECT source_id, k, k FROM kept UNION SELECT r.source_id, l.b, r.root FROM reach r JOIN links l ON l.source_id = r.source_id AND l.a = r.node),
block AS (SELECT source_id, node AS k, min(root) AS block FROM reach GROUP BY source_id, node),
seen AS (SELECT source_id, k, count(DISTINCT id) AS support FROM keyed SEMI JOIN kept USING (source_id, k) GROUP BY source_id, k),
best AS (SELECT source_id, a AS k, max(w) AS edge_support FROM links GROUP BY source_id, a)
SELECT source_id AS source, count(*) AS lines, max(support) AS support, max(edge_support) AS edge_support
FROM block JOIN seen USING (source_id, k) LEFT JOIN best USING (source_id, k) GROUP BY source_id, block""",
}
