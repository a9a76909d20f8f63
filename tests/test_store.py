import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from marlinspike import jobs
from marlinspike.operators import completion, constraints, enrich, profiles, reports, scoring, tables
from marlinspike.sources import feeds, http, registry
from marlinspike.streaming import intake


def test_facts_fold_like_one_change_after_another(spark):
    rnd, log, want = random.Random(4), [], {}
    for user, field in itertools.product("ab", "xyz"):
        held = None
        for k in range(rnd.randint(1, 12)):
            source, value = rnd.choice(["stated", "observed", "imported"]), rnd.choice([None, "v1", "v2"])
            log.append((user, field, source, dt.datetime(2025, 1, 1 + k // 3), k, value))
            if not (held and held[1] == "stated" and source != "stated"):
                held = (value, source) if value is not None else None
        if held:
            want[user, field] = held
    rnd.shuffle(log)
    df = spark.createDataFrame([*log, (None, "x", "stated", None, 1, "v")], "user_id string, field string, source string, at timestamp, seq int, value string")
    assert {(r.user_id, r.field): (r.value, r.source) for r in profiles.current_facts(df).collect()} == want
    assert profiles.current_facts(df.limit(0)).count() == 0


def test_setting_and_clearing_facts(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    people = spark.createDataFrame([(u, day(1), day(1)) for u in ("a", "b", "c")], "user_id string, created_at timestamp, updated_at timestamp")
    facts = spark.createDataFrame([("a", "languages", (["en"], 1.0), "stated", day(1)), ("b", "languages", (["en"], 0.5), "observed", day(1))], "user_id string, field string, value struct<items:array<string>,confidence:double>, source string, stated_at timestamp")
    changes = [
        ("a", "languages", "observed", 0.5, day(2), 1, ["de"]),  # a person's own answer stands
        ("a", "residence_country", "stated", 1.0, day(2), 2, ["pl"]),  # codes are upper case
        ("a", "languages", "observed", 1.0, day(3), 3, None),  # nor may it be cleared
        ("b", "languages", "stated", 1.0, day(2), 4, []),  # an empty list is an answer
        ("b", "professions", "stated", 1.0, day(2), 5, ["nonsense"]),
        ("b", "career_goal", "stated", 1.0, day(2), 6, ["profession=deck", "country=no"]),
        ("b", "career_goal", "stated", 1.0, day(3), 7, ["profession=nonsense"]),
        ("b", "career_goal", "stated", 1.0, day(3), 8, []),
        ("b", "hobby", "stated", 1.0, day(2), 9, ["x"]),
        ("b", "certificates", "stated", 0.9, day(2), 10, ["stcw"]),
        ("c", "languages", "stated", 1.0, day(2), 11, None),  # clearing nothing touches nothing
        ("zz", "languages", "stated", 1.0, day(2), 12, ["en"]),
    ]
    touched, after, refused = profiles.set_facts(people, facts, spark.createDataFrame(changes, profiles.CHANGE), F.lit(day(9)))
    assert {(r.user_id, r.field): (list(r.value["items"]), r.source) for r in after.collect()} == {
        ("a", "languages"): (["en"], "stated"), ("a", "residence_country"): (["PL"], "stated"), ("b", "languages"): ([], "stated"), ("b", "career_goal"): (["profession=deck", "country=NO"], "stated"),
    }
    assert {r.user_id: r.updated_at for r in touched.collect()} == {"a": day(9), "b": day(9), "c": day(1)}
    assert {r.seq: list(r.errors) for r in refused.collect()} == {1: ["stated_is_protected"], 3: ["stated_is_protected"], 5: ["unknown_key"], 7: ["unknown_key"], 8: ["empty_goal"], 9: ["unknown_field"], 10: ["stated_not_certain"], 12: ["no_profile"]}
    assert profiles.profile_of(people, "a").count() == 1 and profiles.profile_of(people, "x").count() == 0


def test_journal_takes_all_events_or_none(spark, tmp_path):
    people = spark.createDataFrame([("a",)], "user_id string")
    schema = "id long, user_id string, dwell_seconds int"
    journal = tables.ParquetTable(spark, str(tmp_path / "journal"))
    assert profiles.append_events(journal, spark.createDataFrame([(1, "a", None), (1, "a", 5)], schema), people) == 2
    for bad in ((2, "b", 1), (2, "a", -1)):
        with pytest.raises(ValueError):
            profiles.append_events(journal, spark.createDataFrame([(3, "a", 1), bad], schema), people)
    assert journal.read().count() == 2


def test_broken_constraints(spark):
    rows = spark.createDataFrame([(1, ("v", "source", 0.9), "A" * 64, -1), (2, ("v", "rule", 1.5), "a" * 64, None), (3, None, None, 0)], "id int, f struct<value:string,provenance:string,confidence:double>, content_hash string, dwell_seconds int")
    rules = constraints.derived_rules("f") | constraints.event_rules() | {"content_hash": constraints.F.col("content_hash").rlike("^[0-9a-f]{64}$")}
    assert sorted(tuple(r) for r in constraints.broken(rows, "id", rules).collect()) == [("1", "content_hash"), ("1", "dwell_negative"), ("1", "f:source_not_certain"), ("2", "f:confidence")]
    goal = spark.createDataFrame([(1, ((None, None, None),)), (2, (("deck", None, None),)), (3, None)], "id int, career_goal struct<value:struct<profession:string,direction:string,country:string>>")
    assert [tuple(r) for r in constraints.broken(goal, "id", constraints.goal_rules()).collect()] == [("1", "goal_empty")]


def test_streamed_facts_fold_batch_by_batch(spark, tmp_path):
    schema = "user_id string, field string, source string, at timestamp, seq long, value string"
    batches = [
        [("a", "x", "stated", dt.datetime(2025, 1, 5), 1, "own"), ("b", "x", "observed", dt.datetime(2025, 1, 5), 2, "seen")],
        [("a", "x", "observed", dt.datetime(2025, 1, 9), 3, "seen"), ("b", "x", "observed", dt.datetime(2025, 1, 1), 4, "late"), ("b", "y", "stated", dt.datetime(2025, 1, 1), 5, "own")],
        [("a", "x", "stated", dt.datetime(2025, 1, 9), 6, None), ("b", "y", "observed", dt.datetime(2025, 1, 9), 7, None)],
    ]
    kept = tables.ParquetTable(spark, str(tmp_path / "facts"))
    step, seen = intake.fact_fold(kept), []
    for i, rows in enumerate(batches):
        step(spark.createDataFrame(rows, schema), i)
        seen.append({(r.user_id, r.field): r.value for r in kept.read().collect()})
    assert seen == [{("a", "x"): "own", ("b", "x"): "seen"}, {("a", "x"): "own", ("b", "x"): "late", ("b", "y"): "own"}, {("b", "x"): "late", ("b", "y"): "own"}]


def test_feeds_of_one_host_share_a_partition():
    feeds_ = [["a", "https://x.example/a"], ["b", "https://X.example/b"], ["c", "https://y.example/c"]]
    parts = http._Reader({"feeds": json.dumps(feeds_)}).partitions()
    assert [len(p.feeds) for p in parts] == [2, 1]


def test_facts_and_export_of_one_very_busy_person(spark):
    log = spark.range(6000).selectExpr("if(id % 3 = 0, 'busy', 'u' || id % 500) AS user_id", "'goal' AS field", "if(id % 1000 = 0, 'stated', 'observed') AS source", "timestamp_seconds(id) AS at", "id AS seq", "if(id % 2000 = 0, null, 'v' || id) AS value", "id AS extra")
    facts = {r.user_id: (r.value, r.source) for r in profiles.current_facts(log).collect()}
    # The last stated change of the busy person is the one of 3000 (4500 and others aren't stated); it stands.
    assert facts["busy"] == ("v3000", "stated") and len(facts) == 501
    journal = spark.range(3000).selectExpr("if(id % 3 = 0, 'busy', 'u' || id % 50) AS user_id", "3000 - id AS id", "timestamp_seconds(id % 7) AS occurred_at", "id AS opportunity_id", "'view' AS action")
    people = spark.createDataFrame([("busy",), ("silent",)], "user_id string")
    rows = profiles.export(people, journal)
    assert rows.where("user_id = 'busy'").count() == 1000 and rows.where("user_id = 'silent' and event_id is null").count() == 1
    got = [(r.user_id, r.occurred_at, r.event_id) for r in rows.collect()]
    assert [x for x in got if x[0] == "busy"] == sorted(x for x in got if x[0] == "busy")
    assert [len(profiles.export_of(people, journal, u).first().events) for u in ("busy", "silent")] == [1000, 0] and profiles.export_of(people, journal, "none").count() == 0


def test_interest_counts_keep_null_keys_apart(spark):
    j = spark.createDataFrame([("u", 1, "view"), ("u", 1, "view"), ("u", 9, "view")], "user_id string, opportunity_id long, action string")
    o = spark.createDataFrame([(1, "cruise", None)], "id long, direction string, profession string")
    got = sorted(((r.dimension, r.key, r.n) for r in profiles.interest_counts(j, o).collect()), key=str)
    assert got == sorted([("total", None, 3), ("direction", "cruise", 2), ("direction", None, 1), ("profession", None, 3)], key=str)


def _pair(spark, profile, posting):
    p = "struct<career_stage:struct<value:string,confidence:double>,professions:struct<value:array<string>,confidence:double>,directions:struct<value:array<string>,confidence:double>,languages:struct<value:array<string>,confidence:double>,certificates:struct<value:array<string>,confidence:double>,preferred_countries:struct<value:array<string>,confidence:double>,hiring_country:struct<value:array<string>,confidence:double>,career_goal:struct<value:struct<profession:string,direction:string,country:string>,confidence:double>>"
    one, many = "struct<value:string,provenance:string,confidence:double,quotes:map<string,string>>", "struct<value:array<string>,provenance:string,confidence:double,quotes:map<string,string>>"
    o = f"struct<type:string,profession:{one},direction:{one},required_languages:{many},experience_level:{one},required_certificates:{many},country:{one},hiring_scope:struct<anywhere:boolean,countries:array<string>,unresolved:array<string>,provenance:string,confidence:double>>"
    r = scoring.score(spark.createDataFrame([(profile, posting)], f"profile {p}, posting {o}")).first()
    return r.value, r.comparable_factors, {v.factor: v for v in r.verdicts}


def test_unknown_is_left_out_of_the_score(spark):
    assert _pair(spark, {}, {"type": "job"})[:2] == (None, 0)
    value, n, v = _pair(spark, {"professions": (["Deck"], 1.0), "languages": ([], 1.0)}, {"type": "job", "profession": ("deck", "rule", 0.5, None), "required_languages": (["en"], "rule", 0.9, None)})
    assert n == 2 and value == pytest.approx(0.5 / 1.4) and v["languages"].outcome == "mismatch" and v["profession"].posting_evidence == "deck [rule]"
    assert [x for x in v] == ["profession", "direction", "languages", "experience", "certificates", "country", "hiring_country", "career_goal"]


def test_zero_confidence_and_empty_preference(spark):
    value, n, _ = _pair(spark, {"professions": (["deck"], 0.0), "directions": ([], 1.0)}, {"type": "job", "profession": ("deck", "rule", 0.9, None), "direction": ("cruise", "rule", 1.0, None)})
    assert (value, n) == (None, 1)


def test_internship_closes_only_a_shortfall(spark):
    need = {"required_certificates": (["stcw"], "rule", 0.9, None)}
    job, intern = ({"type": t, **need} for t in ("job", "internship"))
    v = _pair(spark, {"certificates": ([], 1.0)}, job)[2]["certificates"]
    assert v.outcome == "mismatch" and list(v.caveats) == ["training_offer_signal_unavailable"] and v.profile_evidence == "none"
    assert _pair(spark, {"certificates": ([], 1.0)}, intern)[2]["certificates"].outcome == "not_comparable"
    assert _pair(spark, {"certificates": (["STCW"], 1.0)}, intern)[2]["certificates"].outcome == "match"


def test_hiring_office(spark):
    wants = {"hiring_country": (["nl"], 1.0)}
    out = lambda *s: _pair(spark, wants, {"type": "job", "hiring_scope": (*s, "rule", 1.0)})[2]["hiring_country"]
    assert out(True, [], []).outcome == "match" and out(False, ["NL"], ["rest"]).outcome == "match" and out(False, ["US"], []).outcome == "mismatch"
    assert list(out(False, [], ["Caribbean"]).caveats) == ["hiring_office_not_normalised"] and list(out(False, ["NL"], ["rest"]).caveats) == ["hiring_office_not_normalised"]


def test_goal_takes_the_weakest_link(spark):
    v = _pair(spark, {"career_goal": (("deck", "cruise", None), 1.0)}, {"type": "job", "profession": ("Deck", "rule", 0.75, None), "direction": ("cruise", "rule", 1.0, None)})[2]["career_goal"]
    assert (v.outcome, v.weight) == ("match", 0.75)


def test_parquet_table_is_replaced_whole(spark, tmp_path):
    t = tables.ParquetTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.ensure("k int, v string")
    t.append(spark.createDataFrame([(1, "a")], "k int, v string"))
    t.replace(tables.upsert(t.read(), spark.createDataFrame([(1, "b"), (None, "n")], "k int, v string"), ["k"]))
    t.vacuum()
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, "b"), (None, "n")]


def test_insert_new_takes_one_per_key_and_all_null_keys(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 5), (None, 6)], "k string, v int")
    assert sorted((r.v for r in tables.insert_new(old, new, ["k"], order=["v"]).collect())) == [3, 5, 6]


class _Fake:
    def extract(self, text):
        if "fail" in text:
            raise ConnectionError
        return {"experience_level": {"value": "mid", "quote": "long  text", "basis": "stated"}, "required_certificates": [{"key": "stcw", "quote": "an STCW card", "basis": "inferred"}, {"key": "stcw", "quote": "an STCW card", "basis": "stated"}, {"key": "coc", "quote": "an STCW card", "basis": "stated"}, {"key": "zzz", "quote": "long text", "basis": "stated"}]}


def test_completion_fills_only_nulls_with_verified_quotes(spark):
    lvl, lst = "struct<value:string,provenance:string,confidence:double,quotes:map<string,string>>", "struct<value:array<string>,provenance:string,confidence:double,quotes:map<string,string>>"
    rows = spark.createDataFrame([(1, "a long text that asks for an STCW card", None, None), (2, "a long text that asks for an STCW card", ("entry", "rule", 0.9, None), None), (3, "this one will fail every time it is asked", None, None), (4, "short", None, None), (5, None, None, None)], f"id int, text string, experience_level {lvl}, required_certificates {lst}")
    none = spark.createDataFrame([], completion.CACHE)
    new = completion.ask(rows, none, _Fake, "5", "m").cache()
    assert new.count() == 1 and completion.ask(rows, new, _Fake, "5", "m").count() == 0
    got = {r.id: r for r in completion.complete(rows, completion.merge_cache(none, new), "5", "m").collect()}
    assert got[1].experience_level.value == "mid" and list(got[1].required_certificates.value) == ["stcw"] and got[1].required_certificates.confidence == 0.6
    assert got[1].experience_level.quotes == {"mid": "long  text"} and got[1].required_certificates.quotes == {"stcw": "an STCW card"}
    assert got[2].experience_level.value == "entry" and got[3].experience_level is None and got[5].required_certificates is None


def test_answers_are_stored_before_they_are_read(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    class Counting:
        def extract(self, text):
            asked.add(1)
            return {"experience_level": {"value": "mid", "quote": text[:11], "basis": "stated"}, "required_certificates": []}

    rows = spark.createDataFrame([(1, "a text long enough to be asked about"), (2, "another text long enough to be asked")], "id int, text string").selectExpr("*", "cast(null as struct<value:string,provenance:string,confidence:double,quotes:map<string,string>>) AS experience_level", "cast(null as struct<value:array<string>,provenance:string,confidence:double,quotes:map<string,string>>) AS required_certificates")
    stored = tables.ParquetTable(spark, str(tmp_path / "cache"))
    cache = completion.refresh_cache(stored, rows, Counting, "5", "m")
    out = completion.complete(rows, cache, "5", "m")
    assert out.count() == 2 and [r.experience_level.value for r in out.collect()] == ["mid", "mid"] and asked.value == 2
    completion.refresh_cache(stored, rows, Counting, "5", "m")
    assert asked.value == 2 and stored.read().count() == 2


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    t = tables.ParquetTable(spark, str(tmp_path / "t"))
    t.ensure("k int")
    t._point(1, t.version())
    with pytest.raises(FileExistsError):
        t._point(1, "other")
    t.replace(spark.createDataFrame([(5,)], "k int"))
    assert [r.k for r in t.read().collect()] == [5]


def test_evidence_has_the_quote(spark):
    v = _pair(spark, {"certificates": (["stcw"], 1.0), "professions": (["deck"], 1.0)}, {"type": "job", "profession": ("deck", "llm", 0.9, {"deck": "deck hands wanted"}), "required_certificates": (["stcw", "coc"], "llm", 0.9, {"stcw": "valid STCW documents"})})[2]
    assert v["profession"].posting_evidence == "deck: deck hands wanted [llm]" and v["certificates"].posting_evidence == "stcw: valid STCW documents, coc [llm]"


def test_retries_then_gives_up():
    calls = []

    class Broken:
        def extract(self, text):
            calls.append(text)
            raise TimeoutError

    with pytest.raises(TimeoutError):
        completion.Retrying(Broken(), retries=2, pause=0).extract("x")
    assert len(calls) == 3


def test_quotas_fill_up_from_the_largest_remainders():
    assert reports.quotas({"a": 1, "b": 10, "c": 10}, 11) == {"a": 1, "b": 5, "c": 5}
    assert reports.quotas({"a": 3}, 10) == {"a": 3}
    assert reports.quotas({"n": 20, "a": 2, "b": 2}, 8, favoured="n", favoured_most=4)["n"] >= 4


def test_spread_ignores_nulls(spark):
    runs = spark.createDataFrame([("f", 0.5, None), ("f", None, None)], "field string, p double, r double")
    got = {r.metric: (r.mean, r.least, r.most) for r in reports.spread(runs, ["p", "r"]).collect()}
    assert got == {"p": (0.5, 0.5, 0.5), "r": (None, None, None)}


FEED = '{"data": [{"id": "1", "url": "https://x.example/1", "title": "Bosun", "description": "<p>Hi</p>", "job": {"department": {"name": "Deck"}}, "location": {"name": "Global"}}]}'


def test_feeds_and_jobs_end_to_end(spark, tmp_path):
    (tmp_path / "feed.json").write_text(FEED)
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>Cook &amp; baker</title><guid>https://x/vacId/77</guid><link>https://x.example/77</link><description>Text</description></item></channel></rss>")
    reg = spark.createDataFrame([("j", "berthfeed", "primary", "cruise", "vessel"), ("x", "crewline", "primary", None, None)], "source_id string, platform string, trust string, direction string, workplace_type_hint string")
    at = str(tmp_path / "tables")
    assert jobs.ingest(spark, at, reg, "j", str(tmp_path / "feed.json")) == (1, 1)
    assert jobs.ingest(spark, at, reg, "j", str(tmp_path / "feed.json")) == (0, 1)
    r = jobs.coverage(spark, at, "j").first()
    assert (r.total, r.rejected) == (1, 1)
    with pytest.raises(LookupError):
        jobs.coverage(spark, at, "nobody")
    item = feeds.read_rss_feed(spark, str(tmp_path / "feed.xml"), "x").first()
    assert item.external_id == "77" and item.payload.startswith("<item>") and item.payload.endswith("</item>")
    assert jobs.ingest(spark, at, reg, "x", str(tmp_path / "feed.xml")) == (1, 2)
    for bad in ("<item><title>T</title><link>https://x.example/1</link></item>", "<item><title>T</title><guid>https://x/vacId/1</guid></item>"):
        (tmp_path / "bad.xml").write_text(f"<rss><channel>{bad}</channel></rss>")
        with pytest.raises(Exception, match="item without"):
            feeds.read_rss_feed(spark, str(tmp_path / "bad.xml"), "x").collect()


def test_registry_errors(spark):
    known = {"a": registry.SourceConfig("a", "unheard"), "b": registry.SourceConfig("b", "account_feed")}
    with pytest.raises(KeyError):
        registry.reader_for(known, "zzz")
    for s in "ab":
        with pytest.raises(ValueError):
            registry.reader_for(known, s)


def test_polite_client_retries_waits_and_obeys_robots():
    answers, slept = [(503, b""), (200, b"ok")], []
    c = http.Polite("me", interval=0, get=lambda u, h, t: answers.pop(0), sleep=slept.append)
    assert c.get("https://x.example/a") == b"ok" and slept
    with pytest.raises(OSError):
        http.Polite("me", interval=0, get=lambda u, h, t: (404, b""), sleep=slept.append).get("https://x.example/a")
    rules = http.Polite("me", get=lambda u, h, t: (200, b"User-agent: *\nDisallow: /private"))
    assert rules.allowed("https://x.example/a") and not rules.allowed("https://x.example/private/b")
    assert http.Polite("me", get=lambda u, h, t: (404, b"")).allowed("https://x.example/private")


def test_streamed_intake_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", "h", dt.datetime(2025, 1, 1)), ("s", "a", "h", dt.datetime(2025, 1, 2)), ("s", "b", "h", dt.datetime(2025, 1, 1))], "source_id string, external_id string, content_hash string, fetched_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    t = tables.ParquetTable(spark, str(tmp_path / "raw"))
    for run in "ab":
        intake.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), intake.raw_intake(t), str(tmp_path / f"cp{run}")).awaitTermination()
    assert t.read().count() == 2
    assert t.read().agg(F.max("fetched_at")).first()[0] == dt.datetime(2025, 1, 1)


def test_lost_certificates_against_a_direct_count(spark):
    payloads = [
        ("s", json.dumps({"id": "1", "title": "Cook", "description": "<p>needs STCW</p>", "contacts": {"note": "HUET and <b>STCW</b>"}})),
        ("s", json.dumps({"id": "2", "title": "Cook", "description": "no papers", "nested": [{"deep": {"x": "valid HUET"}}]})),
        ("s", json.dumps({"id": "3", "title": "Cook", "benefits": "HUET"})),
        ("r", "<item><title>Cook</title><guid>x/vacId/9</guid><featured>STCW</featured><description>no papers</description></item>"),
    ]
    raw = spark.createDataFrame([(i, s, str(i), "https://x.example", p, "h") for i, (s, p) in enumerate(payloads)], "id long, source_id string, external_id string, url string, payload string, content_hash string")
    read = feeds.normalize(raw).select("id", enrich.qualification_text(F.col("source_fields"), F.col("description")).alias("readable"))
    rows = reports.lost_certificates(raw.join(read, "id"), F.col("payload"), F.col("readable"), expected=["stcw"], by=["source_id"]).collect()
    assert [(r.source_id, r.key, r.n, r.expected) for r in rows] == [("s", "huet", 2, False), ("r", "stcw", 1, True)]
