"""Quantities recorded in different units: pay in any currency, period, scale and notation to US dollars a month.

A multi-pattern automaton finds unit aliases in the figure's own text, then in the posting's description, then
in the source's pay note; the longest alias wins and the field decides what an alias may mean. Factors are
joined afterwards from the rate and period tables, so the arithmetic is exact decimal arithmetic in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.functions.automaton import PhraseAutomaton

CURRENCY_ALIASES = {
    "USD": ["usd", "us$", "$", "dollars", "dollar", "us dollars", "us dollar"],
    "EUR": ["eur", "euro", "euros", "€", "the euro"],
    "GBP": ["gbp", "£", "pounds sterling", "pound sterling", "pounds"],
    "NOK": ["nok", "norwegian kroner", "norwegian crowns", "norwegian krone"],
    "RUB": ["rub", "руб.", "руб", "₽", "russian roubles", "russian rubles", "roubles", "rubles"],
    "PHP": ["php", "₱", "philippine pesos", "philippine peso"],
    "PLN": ["pln", "zł", "zl", "polish zloty", "polish złoty", "zloty", "złoty"],
    "BRL": ["brl", "r$", "brazilian reais", "reais"],
    "CAD": ["cad", "ca$", "c$", "canadian dollars", "canadian dollar"],
    "THB": ["thb", "฿", "thai baht", "baht"],
}
#: Words for a period that may stand right beside a figure.
PERIOD_ALIASES = {
    "hour": ["per hour", "an hour", "a hour", "/hour", "/ hour", "/hr", "/ hr", "/h", "/ h", "ph", "hourly", "/hourly", "/ hourly", "by the hour", "one hour", "p.h.", "pro stunde", "/stunde", "za godzinę"],
    "day": ["per day", "a day", "/day", "/ day", "/d", "/ d", "pd", "daily", "/daily", "/ daily", "by the day", "one day", "p.d.", "pro tag", "/tag", "dziennie", "в день"],
    "week": ["per week", "a week", "/week", "/ week", "/wk", "/ wk", "pw", "weekly", "/weekly", "/ weekly", "by the week", "one week", "p.w.", "pro woche", "/woche", "tygodniowo", "в неделю"],
    "month": ["per month", "a month", "/month", "/ month", "/mo", "/ mo", "monthly", "/monthly", "/ monthly", "by the month", "one month", "p.m.", "pm", "pcm", "mtl.", "mtl", "/monat", "/ monat", "pro monat", "miesięcznie", "в месяц", "/мес.", "/ мес.", "/мес", "мес."],
    "year": ["per year", "a year", "/year", "/ year", "/yr", "/ yr", "yearly", "/yearly", "/ yearly", "annually", "per annum", "/annum", "p.a.", "pa", "annual", "by the year", "one year", "a full year", "full year", "pro jahr", "/jahr", "rocznie", "в год"],
}
#: Further notations in a field that holds nothing but the period.
PERIOD_FIELD = {"h": "hour", "hr": "hour", "hour": "hour", "d": "day", "day": "day", "wk": "week", "week": "week", "mo": "month", "mth": "month", "month": "month", "yr": "year", "year": "year", "annum": "year"}
SCALE_ALIASES = {"thousands of": Decimal(1000), "cents of": Decimal("0.01"), "cents": Decimal("0.01"), "in thousands": Decimal(1000)}
#: Words that may stand beside a figure without saying what it counts; a figure that has no unit may have no other words about it.
FILLER = ["salary", "pay", "wage", "wages", "approx", "approx.", "about", "ca", "ca.", "plus keep", "plus", "keep", "depending on rank", "to", "and", "gross", "net", "basic", "figure"]
LOW_WORDS, HIGH_WORDS = ["from", "min.", "min", "at least", "starting at"], ["up to", "max.", "max", "not more than"]
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())} | {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}

_WORD_NUMBER = "(?:" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
_NUMBER = re.compile(
    r"(?P<digits>\d{1,3}(?:[   '’]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)*)(?:,-|\.-)?(?P<k>\s?k\b|\s?thousand\b|\s?тыс\.?)?"
    rf"|\b(?P<words>{_WORD_NUMBER}(?:[ -]{_WORD_NUMBER})*(?: hundred)?) thousand\b|\b(?P<hundreds>{_WORD_NUMBER}) hundred\b"
)
_RANGE = re.compile(r"\s*(?:-|–|—|to|bis|до|do)\s*")


@lru_cache(1)
def _aliases() -> PhraseAutomaton:
    said: list[tuple[str, object]] = []
    for kind, lists in (("currency", CURRENCY_ALIASES), ("period", PERIOD_ALIASES)):
        said += [(alias, (kind, code)) for code, words in lists.items() for alias in words]
    said += [(alias, ("scale", factor)) for alias, factor in SCALE_ALIASES.items()]
    said += [(w, ("low", None)) for w in LOW_WORDS] + [(w, ("high", None)) for w in HIGH_WORDS]
    return PhraseAutomaton(said + [(w, ("filler", None)) for w in FILLER])


def parse_number(digits: str) -> Decimal:
    """1.850 / 9,999 / 14'500 / 13 000,50 to a Decimal: the last separator is the decimal one unless three digits follow it."""
    s = re.sub(r"[   '’]", "", digits)
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        mark = "." if s.rfind(".") > s.rfind(",") else ","
        return Decimal(s.replace("," if mark == "." else ".", "").replace(mark, "."))
    if dots + commas == 1 and not re.search(r"[.,]\d{3}$", s):
        return Decimal(s.replace(",", "."))
    return Decimal(re.sub("[.,]", "", s))


def _value(m: re.Match) -> Decimal:
    if m["digits"]:
        return parse_number(m["digits"]) * (1000 if m["k"] else 1)
    total = sum(NUMBER_WORDS.get(w, 0) for w in re.split("[ -]", m["words"] or m["hundreds"]))
    return Decimal(total * (100 if m["hundreds"] or "hundred" in (m["words"] or "") else 1) * (1000 if m["words"] else 1))


_OTHER = re.compile(r"[^\W\d_]|[$€£¥₹₩₺₴₫₦₱฿]")
_NEXT_WORD = re.compile(r"\s*([^\W\d_]+|[¥₹₩₺₴₫₦])")
_LAST_WORD = re.compile(r"([^\W\d_]+|[¥₹₩₺₴₫₦])[.:]?\s*$")


class _Figures:
    """The numbers of a pay text, the unit aliases about them, and what is neither."""

    def __init__(self, s: str):
        self.s, self.numbers = s, list(_NUMBER.finditer(s))
        rest = list(s)
        for m in self.numbers:
            rest[m.start() : m.end()] = " " * (m.end() - m.start())
        # A mark between letters and a figure ("us$1", "a day10") doesn't hide the alias: figures became blanks.
        self.found = _aliases().longest("".join(rest)) if self.numbers else []
        for start, end, _ in self.found:
            rest[start:end] = " " * (end - start)
        #: The text without its numbers and aliases.
        self.left = "".join(rest)

    def plain(self) -> bool:
        return not _OTHER.search(self.left)

    def beside(self, m: re.Match, *kinds: str) -> bool:
        """Whether an alias of such a kind stands right beside a number, or only other aliases between."""
        for start, end, (kind, _) in self.found:
            if kind in kinds:
                a, b = (end, m.start()) if end <= m.start() else (m.end(), start)
                if 0 <= b - a <= 40 and not _OTHER.search(self.left, a, b) and not re.search(r"\d", self.s[a:b]) and self.s[a:b].count(",") < 2:
                    return True
        return False

    def counts_other_things(self, m: re.Match) -> bool:
        """Whether the word or sign right beside a number is no alias: "3 meals", "rs 60 000"."""
        after, before = _NEXT_WORD.match(self.left, m.end()), _LAST_WORD.search(self.left[max(0, m.start() - 30) : m.start()])
        covered = lambda at: any(start <= at < end for start, end, _ in self.found)
        after_is = after and not re.search(r"[^\s]", self.s[m.end() : after.start(1)]) and not covered(after.start(1))
        before_is = before and not self.s[m.start() - len(before[0]) + len(before[1]) : m.start()].strip(".: ")
        return bool(after_is or before_is)

    def nearest(self, kind: str, first: re.Match, last: re.Match) -> object | None:
        """What the alias of a kind nearest to a figure says; one behind it goes before one ahead at the same distance."""
        ranked = [(start - last.end() if start >= last.end() else first.start() - end + 0.5 if end <= first.start() else 0, start, code) for start, end, (k, code) in self.found if k == kind]
        return min(ranked, key=lambda x: x[:2])[2] if ranked else None


@lru_cache(200_000)
def parse_pay(text: str) -> tuple[Decimal | None, Decimal | None, str | None, str | None] | None:
    """(minimum, maximum, currency, period) of a pay text, or None if it states no figure for pay.

    A number is pay if a currency stands beside it, or else a period, whatever other words the text has ("USD
    3000 per month plus bonus"); without any unit beside a number the text may hold nothing but filler. A number
    beside a word that is neither counts other things ("3 meals a day") or bears a currency that isn't known
    ("Rs 60 000"). The first such number holds, with the one it makes a range with; the currency and period
    nearest to them are theirs.
    """
    s = text.lower().strip()
    of = _Figures(s)
    if not of.numbers or any(not s[a.end() : b.start()].strip() for a, b in zip(of.numbers, of.numbers[1:])):
        return None
    priced = [m for m in of.numbers if of.beside(m, "currency")]
    if not priced:
        priced = [m for m in of.numbers if of.beside(m, "period") and not of.counts_other_things(m)]
    if not priced:
        if not of.plain() or len(of.numbers) > 2:
            return None
        priced = of.numbers
    at = of.numbers.index(priced[0])
    # The other end of a range may stand before the one that has the unit.
    pair = next(((a, b) for a, b in zip(of.numbers[max(0, at - 1) :], of.numbers[max(1, at) :]) if priced[0] in (a, b) and _is_range(of, a, b)), None)
    if pair is None and len(of.numbers) == 2 and of.plain():
        return None
    first, last = pair or (priced[0], priced[0])
    values = [_value(m) for m in (pair or (first,))]
    if pair:
        if last["k"] and not first["k"] and values[0] * 1000 <= values[1]:
            values[0] *= 1000
        low, high = values
    else:
        up, down = of.beside(first, "high"), of.beside(first, "low") or bool(re.match(r"[^\d,;]{0,12}\+", of.left[first.end() :]) and of.left[first.end() :].split("+")[0].strip() == "")
        low = None if up else values[0]
        high = None if down else values[0]
        if low is None and high is None:
            low = high = values[0]
    return low, high, of.nearest("currency", first, last), of.nearest("period", first, last)


def _is_range(of: _Figures, a: re.Match, b: re.Match) -> bool:
    """Whether two numbers are the ends of a range: a dash or "to" between them, units aside."""
    between = list(of.s[a.end() : b.start()])
    for start, end, (kind, _) in of.found:
        if kind in ("currency", "filler") and a.end() <= start and end <= b.start() and of.s[start:end] != "to":
            between[start - a.end() : end - a.end()] = " " * (end - start)
    if not "".join(between).strip():
        return "between" in of.s[: a.start()] and " and " in of.s[a.end() : b.start()]
    return bool(_RANGE.fullmatch(f" {' '.join(''.join(between).split())} "))


_CUE = re.compile(r"\b(pay|wages?|salary|salaries|figures?)\b")


@lru_cache(50_000)
def _line_units(line: str) -> tuple[str | None, str | None, Decimal | None]:
    found = _aliases().longest(line)
    money = next(((a, b, x) for a, b, (kind, x) in found if kind == "currency"), None)
    periods = [(a, b, x) for a, b, (kind, x) in found if kind == "period"]
    scale = next((x for _, _, (kind, x) in found if kind == "scale"), None)
    if money:
        near = min(periods, key=lambda p: max(p[0] - money[1], money[0] - p[1]), default=None)
        return money[2], near and near[2], scale
    return None, periods[0][2] if periods and _CUE.search(line) else None, scale


def stated_units(text: str | None) -> tuple[str | None, str | None, Decimal | None]:
    """(currency, period, scale) that a text in prose states for pay, each None where it doesn't.

    A currency counts wherever it is named, a period only in the sentence of the currency or in one about pay;
    of several periods there the nearest to the currency.
    """
    if not text:
        return None, None, None
    low = text.lower()
    if not any(True for _ in _money_or_cue().hits(low)):
        return None, None, None
    currency = period = scale = None
    for line in re.split(r"[\r\n]+|(?<=[.!?])\s+(?=[^\d])", low):
        c, p, s = _line_units(line)
        if c and not currency:
            return c, p or period, s
        period = period or p
    return currency, period, scale


@lru_cache(1)
def _money_or_cue() -> PhraseAutomaton:
    words = [a for v in CURRENCY_ALIASES.values() for a in v] + ["pay", "wage", "wages", "salary", "figure", "figures"]
    return PhraseAutomaton((w, None) for w in words)


PARSED = "id long, has_text boolean, low decimal(20,6), high decimal(20,6), currency string, period string, said_currency string, said_period string, note_currency string, note_period string, note_scale decimal(12,4)"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    for frame in frames:
        rows = []
        for id_, raw, description, note in zip(frame["id"], frame["salary_raw"], frame["description"], frame["pay_note"]):
            pay = parse_pay(raw) if raw is not None else None
            if raw is not None and pay is None:
                continue
            low, high, currency, period = pay or (None,) * 4
            said = stated_units(description) if not (currency and period) else (None, None, None)
            noted = _line_units(note.lower()) if note else (None, None, None)
            rows.append((id_, raw is not None, low, high, currency, period, said[0], said[1], noted[0], noted[1], noted[2]))
        yield pd.DataFrame(rows, columns=names)


def _alias_map(lists: dict[str, list[str]], extra: dict[str, str] | None = None) -> Column:
    pairs = {alias: code for code, words in lists.items() for alias in [code.lower(), *words]} | (extra or {})
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def monthly_pay(postings: DataFrame, stored: DataFrame, registry: DataFrame, rates: DataFrame, periods: DataFrame, target: str = "month") -> DataFrame:
    """Every stated bound of pay in US dollars a month: (id, bound, usd_month).

    postings: id, source_id, salary_raw, description; stored: id, salary (struct as in the opportunities table),
    used where salary_raw is null; registry: source_id, pay_note; rates: currency, usd_per_unit; periods:
    period, hours. Units come from the figure, else the posting's description, else the source's note; a
    scale ("thousands of") counts only if the currency comes from the note too. A figure with a currency but no
    period is per month. Rows with a null id give nothing, rows delivered twice count once, empty or very long
    texts are as any others; other columns are ignored.
    """
    text = F.col("salary_raw")
    need = text.isNull() | text.rlike(r"\d") | F.lower(text).rlike("thousand|hundred")
    own = (
        postings.where(F.col("id").isNotNull() & need)
        .select("id", "source_id", "salary_raw", "description")
        .join(registry.where("pay_note is not null").select("source_id", "pay_note").dropDuplicates(["source_id"]), "source_id", "left")
        .select("id", "salary_raw", "description", "pay_note")
        .mapInPandas(_parse, PARSED)
    )
    v = "salary.value."
    kept = stored.where(f"{v}minimum is not null or {v}maximum is not null").select(
        "id",
        F.col(v + "minimum").cast("decimal(20,6)").alias("s_low"),
        F.col(v + "maximum").cast("decimal(20,6)").alias("s_high"),
        F.lower(F.trim(v + "currency")).alias("s_currency"),
        F.lower(F.trim(v + "period")).alias("s_period"),
    )
    at = F.when(F.col("has_text"), F.col("currency"))
    field_currency = F.when(~F.col("has_text") & (F.col("s_currency") != ""), F.coalesce(F.try_element_at(_alias_map(CURRENCY_ALIASES), F.col("s_currency")), F.lit("?")))
    field_period = F.when(~F.col("has_text"), F.try_element_at(_alias_map(PERIOD_ALIASES, PERIOD_FIELD), F.col("s_period")))
    scale = F.when(at.isNull() & field_currency.isNull() & F.col("said_currency").isNull(), F.coalesce("note_scale", F.lit(1))).otherwise(F.lit(1)).cast("decimal(12,4)")
    figures = (
        own.join(kept, "id", "left")
        .where("has_text or s_low is not null or s_high is not null")
        .select(
            "id",
            F.when(F.col("has_text"), F.col("low")).otherwise(F.col("s_low")).alias("low"),
            F.when(F.col("has_text"), F.col("high")).otherwise(F.col("s_high")).alias("high"),
            scale.alias("scale"),
            F.coalesce(at, field_currency, "said_currency", "note_currency").alias("currency"),
            F.coalesce(F.when(F.col("has_text"), F.col("period")), field_period, "said_period", "note_period", F.lit("month")).alias("period"),
        )
    )
    per_target = F.max(F.when(F.col("period") == target, F.col("hours"))).over(_whole())
    hours = periods.select("period", F.col("hours").cast("decimal(12,4)").alias("hours"), per_target.cast("decimal(12,4)").alias("target_hours"))
    usd = F.round((F.col("amount") * F.col("scale")).cast("decimal(24,6)") * F.col("usd_per_unit") * F.col("target_hours") / F.col("hours"), 0).cast("long")
    return (
        figures.join(rates.select("currency", F.col("usd_per_unit").cast("decimal(12,4)")), "currency")
        .join(hours, "period")
        .select("*", F.explode(F.array(F.struct(F.lit("min").alias("bound"), F.col("low").alias("amount")), F.struct(F.lit("max").alias("bound"), F.col("high").alias("amount")))).alias("b"))
        .select("*", "b.bound", "b.amount")
        .where("amount is not null")
        .select("id", "bound", usd.alias("usd_month"))
        .dropDuplicates(["id", "bound"])
    )


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()
