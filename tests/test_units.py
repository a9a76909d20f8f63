from decimal import Decimal

import pytest

from marlinspike.operators.units import monthly_pay, parse_pay, stated_units


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("€39k–€47k per annum", (39000, 47000, "EUR", "year")),
        ("79K to 101,5 K euro annually", (79000, 101500, "EUR", "year")),
        ("422.000,-–498.500,- руб. в месяц", (422000, 498500, "RUB", "month")),
        ("three thousand euro/Monat", (3000, 3000, "EUR", "month")),
        ("up to $145/d", (None, 145, "USD", "day")),
        ("min. 3.900 руб./hr", (3900, None, "RUB", "hour")),
        ("1800 +", (1800, None, None, None)),
        ("US$ 1'650 - US$ 2'150", (1650, 2150, "USD", None)),
        ("13 500,50 NOK", (Decimal("13500.50"), Decimal("13500.50"), "NOK", None)),
        ("USD 3000 per month plus bonus", (3000, 3000, "USD", "month")),
        ("3000 EUR monthly negotiable", (3000, 3000, "EUR", "month")),
        ("Salary: 4,500 USD/month (tax free)", (4500, 4500, "USD", "month")),
        ("USD 250 per day, all found", (250, 250, "USD", "day")),
        ("$ 4k-5k pm", (4000, 5000, "USD", "month")),
        ("1800 per week, 2 meals a day and travel", (1800, 1800, None, "week")),
        ("paid monthly in arrears: 90 GBP per day worked for 6 weeks", (90, 90, "GBP", "day")),
        ("2 positions, up to EUR 400/day depending on experience", (None, 400, "EUR", "day")),
        ("between 3000 and 3,500 EUR, rotation 5/5", (3000, 3500, "EUR", None)),
        ("12,50 - 19,50 € an hour plus keep", (Decimal("12.5"), Decimal("19.5"), "EUR", "hour")),
    ],
)
def test_pay_notations(text, want):
    low, high, currency, period = parse_pay(text)
    assert (low, high, currency, period) == want


@pytest.mark.parametrize("text", ["3 meals a day", "Rs 60 000", "to be discussed after 2 months", "DOE", "", "x" * 100_000, "$" * 50_000, "1 2 3 USD", "Rs 60 000 per month plus bonus", "60 000 INR", "rotation 5/5, 28 days"])
def test_texts_without_a_figure_for_pay(text):
    assert parse_pay(text) is None


def test_units_in_prose():
    assert stated_units("A line twice a week.\nOur ledger keeps US dollars; the figure above is per hour for this rank.")[:2] == ("USD", "hour")
    assert stated_units("Numbers given as pay are thousands of pounds sterling, for a full year.") == ("GBP", "year", Decimal(1000))
    assert stated_units("We call at Europe's ports twice a week.") == (None, None, None)
    assert stated_units(None) == stated_units("") == (None, None, None)


SALARY = "struct<value:struct<minimum:decimal(18,2),maximum:decimal(18,2),currency:string,period:string>>"


def _run(spark, postings, stored=()):
    p = spark.createDataFrame(postings, "id long, source_id string, salary_raw string, description string, extra string")
    s = spark.createDataFrame(list(stored), f"id long, salary {SALARY}, extra string")
    r = spark.createDataFrame([("cents", "Pay figures on this feed are cents of the euro and cover one week."), ("none", None)], "source_id string, pay_note string")
    c = spark.createDataFrame([("USD", Decimal("1")), ("EUR", Decimal("1.1"))], "currency string, usd_per_unit decimal(12,4)")
    h = spark.createDataFrame([("hour", 1), ("day", 8), ("week", 48), ("month", 208), ("year", 2496)], "period string, hours int")
    return sorted((x.id, x.bound, x.usd_month) for x in monthly_pay(p, s, r, c, h).collect())


def test_units_come_from_figure_then_text_then_note(spark):
    rows = [
        (1, "none", "1000 EUR", "Wages here are meant per week, in US dollars, before any deductions.", "x"),
        (2, "none", "1000", "Wages here are meant per week, in US dollars, before any deductions.", "x"),
        (3, "cents", "from 48000", None, "x"),
        (4, "cents", "1000 USD", "", "x"),
        (5, "none", "1000", "nothing", "x"),
        (6, "none", "1000 NOK", None, "x"),
        (2, "none", "1000", "Wages here are meant per week, in US dollars, before any deductions.", "x"),
        (None, None, None, None, None),
        (8, None, None, None, None),
        (9, "none", "0.5 USD", None, None),
    ]
    stored = [(8, ((Decimal(10), None, " usd", "hourly"),), "e"), (8, ((Decimal(10), None, " usd", "hourly"),), "e"), (1, ((Decimal(1), Decimal(1), "USD", "h"),), "e"), (7, None, None)]
    # 1: the text's period fills the figure's gap; 3: cents of a euro a week; 4: a currency of its own takes no scale, but the note's period.
    assert _run(spark, rows, stored) == [(1, "max", 4767), (1, "min", 4767), (2, "max", 4333), (2, "min", 4333), (3, "min", 2288), (4, "max", 4333), (4, "min", 4333), (8, "min", 2080), (9, "max", 1), (9, "min", 1)]


def test_empty_tables(spark):
    assert _run(spark, []) == []
