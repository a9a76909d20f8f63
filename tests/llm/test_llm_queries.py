"""Every llm query against its SQL on the smallest test tables, and subjects against held-out labels."""

import os

import pytest

from marlinspike.llm import queries, subjects
from marlinspike.session import table
from tests.llm.recall import recall

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = sorted(repr(list(r)) for r in df.select(*sorted(df.columns)).collect())
    if name in queries.SQL:
        con = duckdb.connect()
        con.execute(f"create view normalized_opportunities as from '{DIR}/normalized_opportunities.parquet'")
        rel = con.execute(queries.SQL[name])
        names = [d[0] for d in rel.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns) and rows == sorted(repr([r[i] for i in order]) for r in rel.fetchall())


def test_subjects_agree_with_labels_held_out_from_fitting(spark):
    d = DIR.replace("0.001", "0.1")
    labels = table(spark, d, "subject_labels")
    model = subjects.fit(table(spark, d, "documents"), labels.where("doc_id % 4 > 0"))
    apart = {tuple(r) for r in labels.where("doc_id % 4 = 0").select("doc_id", "subject").collect()}
    ids = {i for i, _ in apart}
    mine = {tuple(r) for r in subjects.subjects(table(spark, d, "documents").where("doc_id % 4 = 0"), model).collect() if r[0] in ids}
    assert len(mine & apart) / len(apart) > 0.9 and len(mine & apart) / len(mine) > 0.9


def test_near_duplicates_against_brute_force(spark):
    """Ids divisible by 3 against all rows; the whole count is in tests/llm/recall.py."""
    found, wrong = recall(spark, DIR.replace("0.001", "0.01"), 3)
    pairs, hits = (sum(x) for x in zip(*found.values()))
    assert wrong == 0 and pairs > 50 and hits / pairs > 0.97
