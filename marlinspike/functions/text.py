"""Text functions as Column expressions: all JVM-side, all usable inside whole-stage code."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand in a word, as in Python's \\w.
W = r"[\p{L}\p{N}_]"
#: Named entities worth decoding in feeds; fixed values.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&eacute;": "é", "&euro;": "€", "&pound;": "£", "&amp;": "&"}


def quoted(term: str) -> str:
    """A term as a regular expression that Java and Python read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}/-])", r"\\\1", term)


def word_start_hits(text: Column, terms: Sequence[str]) -> Column:
    """The longest of the (lower-case) terms at every word start of a lower-case text, overlapping ones too.

    One scan: a zero-width look-ahead tries the alternatives, longest first, wherever a word begins. The terms
    need only begin a word, not end one, so plurals match.
    """
    ordered = sorted(dict.fromkeys(terms), key=lambda t: -len(t))
    return F.regexp_extract_all(text, F.lit(rf"(?<!{W})(?=({'|'.join(map(quoted, ordered))}))"), F.lit(1))


def whole_word_hits(text: Column, terms: Sequence[str]) -> Column:
    """The longest of the (lower-case) terms that stand as whole words, at every place of a lower-case text."""
    ordered = sorted(dict.fromkeys(terms), key=lambda t: -len(t))
    return F.regexp_extract_all(text, F.lit(rf"(?<!{W})(?=({'|'.join(map(quoted, ordered))})(?!{W}))"), F.lit(1))


def _kind(values: list) -> str:
    return "string" if isinstance(values[0], str) else "double" if any(isinstance(v, float) for v in values) else "int"


def literal_map(pairs: dict[str, object]) -> Column:
    """A constant map with text keys. It is read from one literal, so the plan has no node per entry; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(pairs, ensure_ascii=False)), f"map<string,{_kind(list(pairs.values()))}>")


def literal_list(values: Sequence[object]) -> Column:
    """A constant array, made like literal_map()."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), f"array<{_kind(list(values))}>")


def unescape(text: Column) -> Column:
    """HTML entities decoded: common named ones and all numbers, decimal or hexadecimal, in one left-to-right sense (&amp; last)."""
    for name, sign in ENTITIES.items():
        if name == "&amp;":
            text = _unescape_numbers(text)
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _unescape_numbers(text: Column) -> Column:
    """Numeric entities by their code points; numbers that are none stay as written."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"), F.lit(1)))

    def decoded(done: Column, code: Column) -> Column:
        n = F.when(F.startswith(code, F.lit("x")), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("bigint")
        sign = F.when(((n > 0) & (n < 0xD800)) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        entity = F.concat(F.lit("&#"), code, F.lit(";"))
        return F.when(sign.isNotNull(), F.replace(done, entity, sign)).otherwise(done)

    return F.when(F.contains(text, F.lit("&#")), F.aggregate(codes, text, decoded)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Markup to lines: scripts, styles and comments dropped, tags are line breaks, blanks in a line collapsed, blank lines dropped; null if nothing is left."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    bare = unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"))
    lines = F.transform(F.split(bare, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{A0}]+", " ")))
    return F.nullif(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit(""))


def strip_markup(html: Column) -> Column:
    """Markup to one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def plain_spaces(text: Column) -> Column:
    """Curly quotes straight, every run of white space (no-break space too) one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "‘’“”", "''\"\""), r"[\s\x{A0}]+", " "))


def quote_in(text: Column, quote: Column) -> Column:
    """Whether a quote stands in a text, white space and quote signs aside, letter case not; null quotes don't."""
    return F.coalesce(F.contains(plain_spaces(text), plain_spaces(quote)), F.lit(False))


def optional(text: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(text), F.lit(""))


def content_hash(payload: Column) -> Column:
    """SHA-256 as hex."""
    return F.sha2(payload, 256)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null if it isn't JSON. Numbers are printed in their shortest form."""
    return F.to_json(F.try_parse_json(text))


def scheme(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL"))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def rfc822(text: Column) -> Column:
    """A feed date ("Mon, 06 Jan 2025 09:35:12 +0000") as a timestamp; null where it isn't one."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")])


def labelled_line(text: Column, label: str) -> Column:
    """What follows "Label:" on its line, letter case of the label aside."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{quoted(label)}:[ \t]*(\S.*)$", 1)), F.lit(""))


def requirements_block(text: Column) -> Column:
    """Text after "Requirements:" up to the next short header line that ends in a colon; null if none."""
    block = F.regexp_extract(text, r"(?is)(?:^|\n)Requirements:[ \t]*(.*?)(?=\n[A-Za-z][^:\n]{0,60}:[ \t]*(?:\n|$)|$)", 1)
    return F.nullif(F.trim(F.regexp_replace(block, r"^\s+|\s+$", "")), F.lit(""))


def required_tail(text: Column) -> Column:
    """tail(), failing the read where the closing lines are missing: for feeds whose every item must have them."""
    found = tail(text)
    return F.when(found.isNull(), F.raise_error(F.lit("item without its closing lines")).cast("struct<description:string,salary:string,join_date:string,duration:string>")).otherwise(found)


def tail(text: Column) -> Column:
    """Struct (description, salary, join_date, duration) of a text that ends in three consecutive lines
    "Salary:", "Join date:" and "Contract duration:"; null if it has no such run. One closing period is dropped."""
    rx = r"(?s)^(.*?)(?:^|\n)Salary:([^\n]*)\nJoin date:([^\n]*)\nContract duration:([^\n]*)(?:\n.*)?$"

    def part(i: int) -> Column:
        return F.regexp_replace(F.trim(F.regexp_extract(text, rx, i)), r"\s*\.$", "")

    return F.when(
        text.rlike(rx),
        F.struct(F.nullif(F.trim(F.regexp_extract(text, rx, 1)), F.lit("")).alias("description"), part(2).alias("salary"), part(3).alias("join_date"), part(4).alias("duration")),
    )


def address(text: Column) -> Column:
    """Comma-separated segments trimmed and rejoined without blank ones and without a closing "NA"."""
    parts = F.transform(F.split(unescape(F.trim(text)), ","), lambda x: F.trim(x))
    cut = F.when(F.lower(F.element_at(parts, -1)) == "na", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.nullif(F.array_join(F.filter(cut, lambda x: x != ""), ", "), F.lit(""))


def positions(hits: Column, pieces: Column) -> Column:
    """Array of (start, end, hit), offsets from 0, from the hits of a pattern and the pieces that it splits the text into.

    hits and pieces should be columns of an earlier projection: regexp_extract_all(text, pattern, 1) and
    split(text, pattern, -1), of a pattern whose first group is all that it consumes. They are zipped before the
    fold, so neither is computed again at every step; both are read twice here, which also keeps the optimizer
    from moving their expressions into the fold.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    zipped = F.slice(F.arrays_zip(pieces.alias("p"), hits.alias("h")), F.lit(1), F.least(F.size(hits), F.size(pieces)))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["h"])
        return F.struct(end.cast("int").alias("at"), F.concat(acc["found"], F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["h"].alias("hit")))).alias("found"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """text[start - before : end + after], cut at the ends."""
    low = F.greatest(F.lit(0), start - before)
    return F.substring(text, low + 1, end + after - low)


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence (between '.', ';' and line breaks) about text[start:end]."""
    left = F.element_at(F.split(F.substring(text, F.lit(1), start), r"[.;\n]", -1), -1)
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^([^.;\n]*)", 1)
    return F.concat(left, F.substring(text, start + 1, end - start), right)


#: Short words by which the rough language guess goes; fixed values.
STOP_WORDS = {"en": "the and of for with you will is", "ru": "и на в с для по от не", "de": "und der die das mit für auf ist", "fr": "le la les et pour avec des est", "es": "el los las para con del una es"}


def rough_language(text: Column) -> Column:
    """The language with most of its short words among a text's words, null if none has two; ties go in listed order."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def score(rank: int, lang: str, listed: list[str]) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(listed))).alias("n"), F.lit(-rank).alias("rank"), F.lit(lang).alias("lang"))

    scores = [score(i, lang, ws.split()) for i, (lang, ws) in enumerate(STOP_WORDS.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] >= 2, best["lang"])


def percent(value: Column) -> Column:
    """A share as text, a dash for null."""
    return F.when(value.isNotNull(), F.format_string("%.1f%%", value * 100)).otherwise("—")


def stratum(text: Column) -> Column:
    """Which requirement hints a text holds, English or Russian: experience, certificates, both or no-signal."""
    low = F.lower(text)
    exp = low.rlike(r"experience|опыт|стаж|плавценз")
    cert = low.rlike(r"certificat|licen[cs]e|stcw|passport|visa|сертификат|диплом|паспорт|виза")
    return F.when(exp & cert, "both").when(exp, "experience").when(cert, "certificates").otherwise("no-signal")
