import datetime as dt
import json

import pytest

from marlinspike import jobs
from marlinspike.__main__ import main as command
from marlinspike.operators import evaluation, model_client, reports, tables
from marlinspike.sources import probe
from marlinspike.sources.http import Polite


def _answer(content):
    return 200, {}, json.dumps({"choices": [{"message": {"content": content}}]}).encode()


def test_chat_client_retries_and_reads():
    answers, slept = [(429, {"Retry-After": "90"}, b""), _answer("no json"), _answer('{"experience_level": null}')], []
    c = model_client.ChatClient("u", "m", "k", sender=lambda *a: answers.pop(0), sleep=slept.append)
    assert c.extract("text") == {"experience_level": None} and slept == [60.0, 1.0]
    with pytest.raises(PermissionError):
        model_client.ChatClient("u", "m", "k", sender=lambda *a: (401, {}, b""), sleep=slept.append).extract("x")
    with pytest.raises(ConnectionError):
        model_client.ChatClient("u", "m", "k", sender=lambda *a: (500, {}, b""), sleep=slept.append).extract("x")


def test_retry_after():
    now = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
    assert model_client.pause_asked("Wed, 01 Jan 2025 00:00:05 GMT", now=now) == 5.0
    assert model_client.pause_asked("soon") is None and model_client.pause_asked(None) is None and model_client.pause_asked("-3") == 0.0
    assert set(model_client.response_schema()["required"]) == {"experience_level", "required_certificates"}


def _get(url, headers, timeout):
    if url.endswith("robots.txt"):
        return (200, b"User-agent: *\nDisallow: /") if "shut" in url else (404, b"")
    return (429, b"") if "busy" in url else (200, b'{"jobs": [1, 2]}') if "open" in url else (200, b"<html>")


def test_probe_counts_and_tells_throttling_apart(spark, tmp_path):
    p = spark.createDataFrame([("a", "https://{slug}.example/jobs")], "platform string, template string")
    e = spark.createDataFrame([("open",), ("busy",), ("shut",), ("gone",), ("open",)], "slug string")
    found = probe.probe(probe.candidates(p, e), lambda: Polite("me", interval=0, attempts=1, get=_get, sleep=lambda s: None)).cache()
    assert {r.slug: (r.status, r.postings) for r in found.collect()} == {"open": ("live", 2), "busy": ("throttled", None), "shut": ("disallowed", None), "gone": ("closed", None)}
    assert tuple(probe.summary(found).first()) == ("a", 4, 1, 2, 1)
    assert probe.listed(b"[1]") == 1 and probe.listed(b"nothing") is None and probe.listed(b'{"data": 3}') is None
    probe.write_found(found, str(tmp_path / "found"))
    assert [r.slug for r in spark.read.json(str(tmp_path / "found")).collect()] == ["open"]


def test_every_platform_counts_its_own_list(spark):
    bodies = {"recruitee": {"offers": [{"title": "T" * 99}], "data": [1, 2]}, "lever": [{"title": "A"}, {}], "workable": {"jobs": []}, "pinpoint": {"jobs": [1]}}
    get = lambda url, headers, timeout: (404, b"") if url.endswith("robots.txt") else next(((200, json.dumps(v).encode()) for k, v in bodies.items() if k in url), (404, b""))
    e = spark.createDataFrame([("acme",)], "slug string")
    rows = probe.probe(probe.candidates(probe.platforms(spark), e), lambda: Polite("me", interval=0, attempts=1, get=get, sleep=lambda s: None)).collect()
    got = {r.platform: (r.status, r.postings, r["sample"]) for r in rows}
    assert len(got) == 8 and got["recruitee"] == ("live", 1, "T" * 60) and got["lever"] == ("live", 2, "A") and got["workable"] == ("empty", 0, None) and got["pinpoint"] == ("closed", None, None) and got["ashby"][0] == "closed"


GOLD = [
    ("s", "1", "x/both", None, "T", "five years experience and a valid STCW card", "senior", "stated", "five years experience", [("stcw", "valid STCW card")], None),
    ("s", "2", "x/no-signal", None, "T", "nothing asked for here", None, None, None, [], None),
]


def _response(level=None, certs=()):
    return json.dumps({"experience_level": level and dict(zip(("value", "quote", "basis"), level)), "required_certificates": [dict(zip(("key", "quote", "basis"), c)) for c in certs]})


def test_evaluation_of_both_fields_over_runs(spark, tmp_path):
    gold = spark.createDataFrame(GOLD, evaluation.GOLD)
    pred = spark.createDataFrame(
        [
            ("s", "1", "a", _response(("senior", "five  years", "stated"), [("stcw", "STCW card", "stated"), ("coc", "STCW card", "stated")])),
            ("s", "2", "b", _response(("mid", "not there", "inferred"), [("stcw", "an STCW card", "inferred")])),
        ],
        evaluation.PREDICTION,
    )
    log = tables.ParquetTable(spark, str(tmp_path / "log"))
    measured, spread, found = jobs.evaluate(gold, pred, log)
    m = {(r.run, r.field): r for r in measured.collect()}
    level, certs = m["a", "experience_level"], m["a", "required_certificates"]
    # The certificate that its quote doesn't name is rejected before it is measured.
    assert (level.precision, level.recall, level.false_fill_rate, level.invalid_quote_rate) == (1.0, 1.0, 0.0, 0.0) and (certs.precision, certs.recall, certs.stated) == (1.0, 1.0, 1)
    none = m["b", "no-signal / required_certificates"]
    assert none.rows == 1 and none.false_fill_rate == 1.0 and none.invalid_quote_rate == 1.0 and none.recall is None and none.inferred == 1
    s = {(r.field, r.metric): (r.mean, r.least, r.most) for r in spread.collect()}
    assert s["experience_level", "precision"] == (0.5, 0.0, 1.0) and s["experience_level", "false_fill_rate"] == (0.25, 0.0, 0.5)
    kinds = [(r.run, r.field, r.kind, r.quote) for r in found.collect()]
    assert kinds == [("a", "certificates", "key_rejected", "STCW card"), ("b", "certificates", "false_fill", "stcw <- an STCW card"), ("b", "certificates", "invalid_quote", "an STCW card"), ("b", "experience", "false_fill", "not there"), ("b", "experience", "invalid_quote", "not there")]
    assert [r.line for r in evaluation.disagreement_lines(found).collect()][0] == "certificates/false_fill: 1"
    assert log.read().count() == 8 and evaluation.spread_lines(spread).count() == 4 and "precision 100.0%" in evaluation.metric_lines(measured).first().line
    assert any("recall —" in r.line for r in evaluation.metric_lines(measured).collect())


def test_gold_files(spark, tmp_path):
    path = str(tmp_path / "gold.yaml")
    sample = spark.createDataFrame([r[:6] for r in GOLD], "source_id string, external_id string, stratum string, url string, title string, text string")
    assert evaluation.write_gold(sample, path) == 2
    done = json.loads(open(path).read())
    done["records"][0] |= {"experience_level": "senior", "required_certificates": ["stcw"], "certificate_quotes": {"stcw": "valid STCW card"}}
    open(path, "w").write(json.dumps(done))
    assert evaluation.write_gold(sample, path) == 0 and json.loads(open(path).read()) == done
    r = evaluation.read_gold(spark, path).where("external_id = '1'").first()
    assert (r.level, [tuple(c) for c in r.certificates]) == ("senior", [("stcw", "valid STCW card")])
    open(path, "w").write("records: 5")
    with pytest.raises(ValueError):
        evaluation.read_gold(spark, path)


class Scripted:
    def extract(self, text):
        return {"experience_level": {"value": "senior", "quote": "five years", "basis": "stated"} if "five" in text else None, "required_certificates": []}


def test_commands(spark, tmp_path):
    said, folder, registry = [], str(tmp_path / "t"), str(tmp_path / "registry")
    spark.createDataFrame([("x", "crewline", "primary", "cruise", "vessel")], "source_id string, platform string, trust string, direction string, workplace_type_hint string").write.parquet(registry)
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>Chief Cook</title><guid>https://x/vacId/77</guid><link>https://x.example/77</link><description>Text</description></item></channel></rss>")
    (tmp_path / "gold.json").write_text(json.dumps({"records": [{"source_id": "s", "external_id": 1, "stratum": "x/both", "text": "five years of experience at sea", "experience_level": "senior"}]}))
    run = lambda *a: command(["--folder", folder, "--registry", registry, *a], spark, said.append)
    assert run("upgrade") == 0 and run("upgrade") == 0 and said[0].endswith("0004_model_answers") and said[1].endswith("none")
    assert run("run", "--source", "x", "--path", str(tmp_path / "feed.xml")) == 0 and said[-1] == "new raw versions: 1; postings: 1"
    first = spark.read.parquet(f"{folder}/opportunities/data/*").first()
    assert run("refetch", "--source", "x", "--path", str(tmp_path / "feed.xml")) == 0 and said[-1].endswith(": 0") and run("reprocess") == 0
    again = tables.ParquetTable(spark, f"{folder}/opportunities").read().first()
    assert again.created_at == first.created_at and again.updated_at > first.updated_at and json.loads(again.enriched)["profession"]["value"] == "ship_cook" and json.loads(again.enriched)["city"] is None
    assert run("coverage", "--source", "x") == 0 and "profession" in said[-1] and run("coverage", "--source", "y") == 2 and run("run", "--source", "zz", "--path", "p") == 2
    assert run("evaluate", "--gold", str(tmp_path / "gold.json"), "--client", "tests.test_clients:Scripted", "--runs", "2", "--show-errors") == 0 and any("experience_level: precision 100.0%" in x for x in said)
    assert run("export", "--user", "nobody") == 2


def test_gold_profile(spark):
    g = spark.createDataFrame([("s", None, [], "no-signal"), ("s", None, ["stcw"], "no-signal"), ("s", "mid", None, "experience")], "source_id string, level string, certificates array<string>, stratum string")
    assert {r.level: (r.records, r.with_certificates, r.no_signal_filled) for r in reports.gold_profile(g).collect()} == {None: (2, 1, 1), "mid": (1, 0, 0)}
