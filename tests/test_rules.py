import pytest
from pyspark.sql import functions as F

from marlinspike.functions import text as fn
from marlinspike.operators import enrich, gate


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("title", "key"),
    [("Provision Master", "provisions"), ("Divemaster wanted", "divemaster"), ("Chief Officers", "chief_officer"), ("bosun", "boatswain"), ("Nothing", None), ("", None), (None, None), ("ëmaster", None), ("Fitter Mechanic", "fitter")],
)
def test_longest_alias_at_a_word_start(spark, title, key):
    assert _one(spark, title, lambda c: enrich.longest_term(c, enrich.PROFESSIONS)) == key


@pytest.mark.parametrize(("place", "code"), [("Caribbean Netherlands", "BQ"), ("Indiana", "IN"), ("Silayukti 5", None), ("Zanzibar, Tanzania", "TZ"), ("Indiana Road, Thailand", "TH"), ("United Kingdom/Scotland", "GB"), ("Virgin Islands (U.S.)", "VI")])
def test_countries(spark, place, code):
    assert _one(spark, place, enrich.country_code) == code


def test_scope_is_one_of_three_kinds(spark):
    rows = spark.createDataFrame([("Global",), ("Guinea-Bissau - X",), ("Poland – Y",), ("",), (None,), (" - X",)], "x string").select(enrich.hiring_scope(F.col("x")).alias("s")).collect()
    got = [r.s and (r.s.anywhere, list(r.s.countries), list(r.s.unresolved)) for r in rows]
    assert got[:4] == [(True, [], []), (False, [], ["Guinea-Bissau"]), (False, ["PL"], []), None] and got[4] is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("$1,300.00 - $1,800.00 / Monthly", (1300, 1800, "USD", "month", 0.6)),
        ("CA$20 / Hourly", (20, 20, "CAD", "hour", 1.0)),
        ("Rs 45,000 / Monthly", None),
        ("up to 3 500 EUR", (None, 3500, "EUR", "month", 0.8)),
        ("up to 3 000 - 3 500 EUR", None),
        ("200 USD per day", (200, 200, "USD", "day", 1.0)),
        ("Up To 200 usd PER DAY", (None, 200, "USD", "day", 1.0)),
        ("3 000 - 3 500 GBP", (3000, 3500, "GBP", "month", 0.8)),
        ("1,300 $ - 1,500$ / weekly", (1300, 1500, "USD", "week", 0.6)),
        ("SR 2,000 - Rs 3,000 / Daily", (2000, 3000, "SAR", "day", 1.0)),
        ("$20 / Hourly / Daily", None),
        ("$20 or so / Hourly", None),
        ("€ - € / Monthly", None),
        ("20 / Monthly", None),
        ("1-2-3 EUR", None),
        ("30 00 EUR", None),
        ("EUR", None),
        ("/", None),
        ("", None),
        (None, None),
    ],
)
def test_regular_pay(spark, raw, want):
    s = _one(spark, raw, enrich.salary)
    assert (s and (s.minimum and int(s.minimum), int(s.maximum), s.currency, s.period, s.confidence)) == want


@pytest.mark.parametrize(
    ("title", "text", "required", "preferred"),
    [
        ("Bar Steward (Japanese Speaking)", "", ["ja"], None),
        ("", "another language such as:\nDutch\nSpanish", None, None),
        ("", "Fluency in Dutch or German is advantageous.", None, ["nl", "de"]),
        ("", "Required: speak English. Preferred: a degree.", ["en"], None),
        ("", "English must be fluent; English is a plus.", ["en"], None),
        ("", "An English breakfast", None, None),
        ("", "Good command of the Japanese language. Able to speak Russian and Korean.", ["ja", "ru", "ko"], None),
        ("", "English is mandatory; Dutch is advantageous", ["en"], ["nl"]),
        ("", "", None, None),
    ],
)
def test_languages_by_sentence(spark, title, text, required, preferred):
    r = enrich.with_languages(spark.createDataFrame([(title, text)], "t string, x string"), F.col("t"), F.col("x")).first()
    assert (r.required, r.preferred) == (required, preferred)


@pytest.mark.parametrize(
    ("text", "level"),
    [
        ("Min 6 months of experience", "junior"),
        ("Experience: 24 months in rank", "mid"),
        ("5+ years experience", "senior"),
        ("Food Hygiene course every 2 years", None),
        ("Contract duration: 5 months. Experience welcome", None),
        ("without prior experience, 10 years", "entry"),
        ("Опыт работы от 3 лет", "mid"),
        ("12  years experience", None),
        ("Must hold STCW. Minimum 12 months of experience in rank.", "junior"),
        ("No prior experience needed. BST required.", "entry"),
        ("Contract duration: 6 months. At least 3 years experience with crane work", None),
        ("Опыт от 24 месяцев в должности.", "mid"),
        ("", None),
        (None, None),
    ],
)
def test_experience(spark, text, level):
    r = enrich.with_experience(spark.createDataFrame([(text,)], "x string"), F.col("x")).first()
    assert (r.experience_level and r.experience_level.value) == level


def test_certificates_keep_the_order_of_the_vocabulary(spark):
    assert _one(spark, "HUET, valid STCW and C1/D; no xSTCWx", enrich.certificate_keys) == ["stcw", "c1d_visa", "huet"]
    assert _one(spark, "PADI", enrich.certificate_keys) is None
    assert _one(spark, "Passport, C1/D and seaman book; Crowd Management preferred", enrich.certificate_keys) is not None


def test_offsets_of_matches(spark):
    rows = spark.createDataFrame([("ab 1 cd 22",), ("none",), (None,)], "x string")
    rows = rows.withColumn("h", F.regexp_extract_all("x", F.lit(r"(\d+)"), F.lit(1))).withColumn("p", F.split("x", r"(\d+)", -1))
    got = [r.a and [(m.start, m.end, m.hit) for m in r.a] for r in rows.select(fn.positions(F.col("h"), F.col("p")).alias("a")).collect()]
    assert got[0] == [(3, 4, "1"), (8, 10, "22")] and not got[1] and not got[2]


def test_text_functions(spark):
    assert _one(spark, "<p>A&amp;B</p><script>x</script><br>C&nbsp; D<!-- n -->", fn.html_to_text) == "A&B\nC D"
    assert _one(spark, "<p> </p>", fn.html_to_text) is None
    assert _one(spark, "it&#39;s &#x2019;&#8217; &#x1F600; &#999999999; &#xD800; &amp;#39;", fn.unescape) == "it's ’’ 😀 &#999999999; &#xD800; &#39;"
    with pytest.raises(Exception, match="closing lines"):
        _one(spark, "no tail", fn.required_tail)
    assert _one(spark, "Street, Shop, NA", fn.address) == "Street, Shop"
    assert _one(spark, "x\nRequirements: a\nb: c\nOther:\nd", fn.requirements_block) == "a\nb: c"
    t = _one(spark, "Salary: first\nText\nSalary: 5 USD.\nJoin date: now\nContract duration: 3 months.", fn.tail)
    assert (t.description, t.salary, t.join_date, t.duration) == ("Salary: first\nText", "5 USD", "now", "3 months")
    assert str(_one(spark, "Mon, 06 Jan 2025 09:35:12 +0200", fn.rfc822)) == "2025-01-06 07:35:12"
    assert _one(spark, '{"b":1,"a":[2]}', fn.canonical_json) == '{"a":[2],"b":1}'
    assert _one(spark, "und der die Crew ist mit dabei", fn.rough_language) == "de"


def test_gate_flags_both_copies_and_scores(spark):
    long = "d" * 100
    post = spark.createDataFrame([("s", "a", "T", "https://x.example/a", long, "h1"), ("s", "b", " N/A ", "ftp://x", None, "h1"), ("t", "c", "T", "https://x.example/__trashed", long, "h1"), ("s", "d", None, None, "", None)], "source_id string, external_id string, title string, url string, description string, content_hash string")
    raw = spark.createDataFrame([("s", "a", "h1"), ("s", "b", "h1"), ("t", "c", "h1"), ("s", "d", None)], "source_id string, external_id string, content_hash string")
    got = {r.external_id: (list(r.quality_flags), r.quality_score, list(r.quality_notes), r.status) for r in gate.gate(post, raw).collect()}
    assert got["a"] == (["duplicate_content"], 0.75, [], "rejected")
    assert got["b"] == (["empty_title", "invalid_url", "description_too_short", "duplicate_content"], 0.0, [], "rejected")
    assert got["c"] == ([], 1.0, ["source_trashed"], "active")
    assert got["d"][0] == ["empty_title", "invalid_url", "description_too_short"]


def test_dictionary_files(tmp_path):
    from marlinspike import vocab

    path = tmp_path / "d.json"
    path.write_text('{"languages": [{"key": "en", "aliases": ["English"]}, {"key": "xx"}]}')
    assert vocab.vocabulary(str(path), "languages") == {"en": ["English"], "xx": []} and vocab.vocabulary(str(path), "none") == {}
    path.write_text("[1]")
    with pytest.raises(ValueError):
        vocab.load_mapping(str(path))
