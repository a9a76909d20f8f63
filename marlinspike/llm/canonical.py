"""Mapping free-entered values to a canonical list: embedded mentions by automaton, the rest by token-set similarity."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.functions.automaton import PhraseAutomaton

NONE = -1
#: Similarity from which a whole token set needs no comparison with letter edits.
SURE = 0.85
#: Words about a place that name none, and words that follow an agency's name.
PLACE_DECOR = {"port", "of", "near", "anchorage", "area", "the", "na", "roads", "bay", "off", "at", "in", "and"}
AGENCY_MARKS = {"agency", "manning", "recruit", "recruiting", "recruitment", "crewing", "desk", "office"}
ORDINALS = {"1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "5th": "fifth"}
ABBREVIATIONS = {"eng": "engineer", "off": "officer", "op": "operator", "tech": "technician", "mgr": "manager", "supt": "superintendent", "asst": "assistant", "jr": "junior", "capt": "captain"}
_TITLE_DECOR = re.compile(r"#\s*\d+|\burgent\b:?|\([mfxdw/ ]+\)|,?\s*\d+\s*months?\b|\s-\s*repost\b|\brepost\b|\(repost\)", re.IGNORECASE)
_FOR = re.compile(r"\s+for\s+(?=\S)|\s+[–—-]\s+|\s+aboard\s+|\s+@\s+", re.IGNORECASE)


def fold(value: str) -> str:
    """Lower case without accents; 0 and 1 inside a word are the letters they look like; other signs are blanks."""
    low = "".join(ch for ch in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(ch))
    low = low.replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("ß", "ss")
    words = [w.replace("0", "o").replace("1", "i") if any(c.isalpha() for c in w) and w not in ORDINALS else w for w in re.findall(r"[^\W_]+", low)]
    return " ".join(words)


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one, now = [], list(range(len(b) + 1)), []
    for i, ca in enumerate(a, 1):
        now = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cb = b[j - 1]
            best = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, two[j - 2] + 1)
            now[j] = best
        if min(now) > most:
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


@dataclass(frozen=True)
class Entry:
    ref_id: int
    kind: str
    country: str | None


class TokenSets:
    """Phrases as weighted token sets, with their tokens indexed by letter pairs.

    A token weighs its length times its rarity among the phrases, so "port" or "officer" says less than a name.
    A value's words match tokens exactly or within `tolerance` of the token's length in letter edits; a phrase's
    similarity is the matched share of its weight, whatever the order of the words and whatever stands between.
    """

    def __init__(self, phrases: list[str], tolerance: float):
        self.tolerance, self.phrases = tolerance, phrases
        self.holders: dict[str, list[int]] = {}
        for i, p in enumerate(phrases):
            for t in dict.fromkeys(p.split()):
                self.holders.setdefault(t, []).append(i)
        self.weight = {t: len(t) * log(1 + len(phrases) / len(held)) for t, held in self.holders.items()}
        self.total = [sum(self.weight[t] for t in set(p.split())) for p in phrases]
        self.pairs: dict[str, list[str]] = {}
        for t in self.holders:
            for pair in self._pairs(t):
                self.pairs.setdefault(pair, []).append(t)
        self.known: dict[str, list[tuple[str, float]]] = {}
        self.longest = max(map(len, self.holders), default=0)

    @staticmethod
    def _pairs(word: str) -> set[str]:
        padded = f" {word} "
        return {padded[i : i + 2] for i in range(len(padded) - 1)}

    def near(self, word: str) -> list[tuple[str, float]]:
        """(token, similarity) of the tokens that a word may be; tokens of too few common letter pairs aren't compared."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = [(word, 1.0)] if word in self.holders else []
            if 3 <= len(word) <= self.longest * (1 + self.tolerance) + 1:
                common = Counter(t for pair in self._pairs(word) for t in self.pairs.get(pair, ()))
                for t, n in common.items():
                    most = max(1, round(self.tolerance * len(t)))
                    # An edit touches two letter pairs, a swap three.
                    if t != word and len(t) >= 3 and abs(len(t) - len(word)) <= most and n >= len(t) - 2 * most and (d := osa(word, t, most)) <= most:
                        found.append((t, 1 - d / max(len(t), len(word))))
            self.known[word] = found
        return found

    def like(self, words: list[str]) -> list[tuple[float, str, frozenset[int], bool]]:
        """(similarity, phrase, positions of the words it takes, whether all its tokens are met) of every phrase within the tolerance."""
        got: dict[int, dict[str, tuple[float, int]]] = {}
        for at, word in enumerate(words):
            for t, how in self.near(word):
                for i in self.holders[t]:
                    best = got.setdefault(i, {})
                    if how > best.get(t, (0.0, 0))[0]:
                        best[t] = (how, at)
        out = []
        for i, best in got.items():
            share = sum(self.weight[t] * how for t, (how, _) in best.items()) / self.total[i]
            if share >= 1 - self.tolerance - 1e-9:
                out.append((share, self.phrases[i], frozenset(at for _, at in best.values()), len(best) == len(set(self.phrases[i].split()))))
        return out


class Matcher:
    """Finds entries of one reference list in values.

    Phrases (names and aliases, folded) are searched by automaton, compact spellings without blanks too; what no
    phrase occurs in goes to token-set similarity. A value in which no phrase has all its tokens, as where blanks
    are wrong, is tried by letter edits on the words run together: letter counts bound the edits from below for
    all phrases at once, and only phrases within `tolerance` of their length are compared. Phrases with most of
    their tokens' weight come last.
    """

    def __init__(self, entries: list[tuple[int, str, list[str], str, str | None]], tolerance: float = 0.34):
        self.tolerance = tolerance
        self.of: dict[str, list[Entry]] = {}
        for ref_id, name, aliases, kind, country in sorted(entries, key=lambda e: e[0]):
            for phrase in (name, *(aliases if aliases is not None else ())):
                if phrase and fold(phrase):
                    self.of.setdefault(fold(phrase), []).append(Entry(int(ref_id), kind, fold(country) if country else None))
        self.phrases = list(self.of)
        self.sets = TokenSets(self.phrases, tolerance)
        spellings = [(p, p) for p in self.phrases] + [(p.replace(" ", ""), p) for p in self.phrases if " " in p]
        self.automaton = PhraseAutomaton(spellings)
        self.compact = [p.replace(" ", "") for p in self.phrases]
        self.bags = np.array([self._bag(c) for c in self.compact], dtype=np.int16).reshape(-1, 37)
        self.allowed = np.array([max(1, round(tolerance * len(c))) for c in self.compact])
        self.longest = max((len(c) + a for c, a in zip(self.compact, self.allowed)), default=0)

    @staticmethod
    def _bag(s: str) -> list[int]:
        bag = [0] * 37
        for ch in s:
            bag[ord(ch) - 97 if "a" <= ch <= "z" else 26 + ord(ch) - 48 if "0" <= ch <= "9" else 36] += 1
        return bag

    def nearest(self, value: str, prefer: Callable[[str], bool] = lambda _: False) -> tuple[float, str] | None:
        """The phrase with the least share of edits, within the tolerance; ties go to a preferred one, then the first."""
        compact = value.replace(" ", "")
        if not self.phrases or not 3 <= len(compact) <= self.longest:
            return None
        diff = self.bags - np.array(self._bag(compact), dtype=np.int16)
        bound = np.maximum(np.clip(diff, 0, None).sum(axis=1), np.clip(-diff, 0, None).sum(axis=1))
        best = None
        for i in np.flatnonzero(bound <= self.allowed):
            d = osa(compact, self.compact[i], int(self.allowed[i]))
            if d <= self.allowed[i]:
                rank = (d / max(len(compact), len(self.compact[i])), not prefer(self.phrases[i]), i)
                if best is None or rank < best[0]:
                    best = (rank, self.phrases[i])
        return best and (best[0][0], best[1])

    def place(self, value: str) -> int:
        """The most specific place meant: port, then country, then region; a port of two countries goes by the country."""
        words = fold(value).split()
        # An agency's name is the word before its mark.
        for at in [i for i, w in enumerate(words) if w in AGENCY_MARKS and i and len(words) > 1]:
            words[at] = words[at - 1] = "|"
        text = " ".join(words)
        hits = [p for _, _, p in self.automaton.longest(text)]
        left = text
        for start, end, _ in sorted(self.automaton.longest(text), reverse=True):
            left = left[:start] + "|" + left[end:]
        countries = {e.country for p in hits for e in self.of[p] if e.kind == "country"}
        runs = [[w for w in run.split() if w not in PLACE_DECOR or len(run.split()) > 1] for run in left.split("|")]
        if not any(e.kind == "port" for p in hits for e in self.of[p]):
            for run in runs:
                found = self._fuzzy(run, countries)
                hits += found
                countries |= {e.country for p in found for e in self.of[p] if e.kind == "country"}
        meant = [e for p in hits for e in self.of[p]]
        ports = [e for e in meant if e.kind == "port"]
        ports = [e for e in ports if e.country in countries] or ports
        for kind in (ports, [e for e in meant if e.kind == "country"], meant):
            if kind:
                return min(kind, key=lambda e: e.ref_id).ref_id if kind is not ports else ports[0].ref_id
        return NONE

    def _fuzzy(self, run: list[str], countries: set[str | None]) -> list[str]:
        """Phrases like a run of words: by whole token sets, best first, no word taken twice; else the nearest by letters; else by part of a set."""
        def prefer(p: str) -> bool:
            return any(e.country in countries for e in self.of[p])

        taken: set[int] = set()
        kept: list[str] = []
        found = sorted(self.sets.like(run), key=lambda x: (-x[0], not prefer(x[1]), -len(x[1]), x[1]))
        for _, p, words, _ in (x for x in found if x[3]):
            if not words & taken:
                taken |= words
                kept.append(p)
        if not kept:
            windows = [run[at : at + size] for size in (3, 2, 1) for at in range(len(run) - size + 1)]
            near = [n for w in windows if not all(x in PLACE_DECOR or x.isdigit() for x in w) and (n := self.nearest(" ".join(w), prefer))]
            kept = [min(near)[1]] if near else [p for _, p, _, _ in found[:1]]
        return kept

    def title(self, value: str) -> int:
        """The profession a job title names: embedded mention, swapped halves ("Cook, Ship"), abbreviations, misspelling."""
        bare = _FOR.split(_TITLE_DECOR.sub(" ", value).strip(" -–,:"))[0]
        spaced = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", bare)
        halves = [h.strip() for h in spaced.split(",") if h.strip()]
        forms = [spaced, bare] + ([" ".join(reversed(halves))] if len(halves) > 1 else [])
        folded = []
        for form in forms:
            words = [ABBREVIATIONS.get(w, ORDINALS.get(w, w)) for w in fold(form).split()]
            folded.append(" ".join(words))
        for text in [*folded, fold(value)]:
            hits = self.automaton.longest(text)
            if hits:
                p = max(hits, key=lambda h: (h[1] - h[0], -h[0]))[2]
                return self.of[p][0].ref_id
        tokens = [" ".join(w for w in f.split() if not w.isdigit()) for f in folded]
        sets = sorted((x for t in dict.fromkeys(tokens) for x in self.sets.like(t.split())), key=lambda x: (not x[3], -x[0], -len(x[1]), x[1]))
        if sets and sets[0][3] and sets[0][0] >= SURE:
            return self.of[sets[0][1]][0].ref_id
        near = [n for n in (self.nearest(t) for t in dict.fromkeys(tokens)) if n]
        if near and not (sets and sets[0][3] and sets[0][0] >= 1 - min(near)[0]):
            return self.of[min(near)[1]][0].ref_id
        return self.of[sets[0][1]][0].ref_id if sets else NONE


def _matching(lists, columns: dict[str, tuple[str, str]], with_value: bool = False):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {name: Matcher(entries) for name, entries in lists.value.items()}
        kept: dict[tuple[str, str], int] = {}
        for frame in frames:
            out = []
            for column, (listed, how) in columns.items():
                find = getattr(matchers[listed], how)
                ids, refs, values = [], [], []
                for id_, value in zip(frame["id"], frame[column]):
                    if value is None:
                        continue
                    ref = kept.get((how, value))
                    if ref is None:
                        if len(kept) > 200_000:
                            kept.clear()
                        ref = kept[how, value] = find(value)
                    if with_value and ref != NONE:
                        continue
                    ids.append(id_)
                    refs.append(ref)
                    values.append(value)
                part = pd.DataFrame({"id": ids, "field": column, "ref_id": refs}).astype({"id": "int64", "ref_id": "int64"})
                out.append(part.assign(value=pd.Series(values, dtype="object", index=part.index)) if with_value else part)
            yield pd.concat(out)

    return run


def _prepared(records: DataFrame, lists: dict[str, DataFrame], columns: dict[str, tuple[str, str]], id_column: str, bound: int):
    """The reference lists, counted and broadcast, and the records' ids and values."""
    taken = {}
    for name, frame in lists.items():
        kind = F.col("place_kind") if "place_kind" in frame.columns else F.lit("entry")
        country = F.col("country") if "country" in frame.columns else F.lit(None).cast("string")
        rows = frame.where("ref_id is not null and name is not null").select("ref_id", "name", "aliases", kind.alias("kind"), country.alias("country")).limit(bound + 1).collect()
        if len(rows) > bound:
            raise ValueError(f"reference list {name} has more than {bound} entries")
        taken[name] = [(r["ref_id"], r["name"], list(r["aliases"] or []), r["kind"], r["country"]) for r in rows]
    return records.sparkSession.sparkContext.broadcast(taken), records.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), *columns)


def canonical_values(records: DataFrame, lists: dict[str, DataFrame], columns: dict[str, tuple[str, str]], id_column: str = "id", bound: int = 100_000) -> DataFrame:
    """(id, field, ref_id) for each non-null value; ref_id -1 where the list has no such entry.

    lists: name -> reference list (ref_id, name, aliases and, for places, place_kind and country); columns:
    field -> (list, "place" or "title"). The lists are counted first and broadcast only up to `bound` entries
    (more raise an error). Values are matched where they lie, each distinct value of a task once, so a value
    that a third of all rows hold costs nothing and nothing is shuffled but the small result, where rows
    delivered twice are dropped. Null values and ids give no rows; empty and very long values are tried as any
    other; an empty list gives -1 throughout; further columns are ignored.
    """
    shared, rows = _prepared(records, lists, columns, id_column, bound)
    return rows.mapInPandas(_matching(shared, columns), "id long, field string, ref_id long").dropDuplicates(["id", "field"])


def unmatched_values(records: DataFrame, lists: dict[str, DataFrame], columns: dict[str, tuple[str, str]], id_column: str = "id", bound: int = 100_000) -> DataFrame:
    """(field, value, n): values without an entry, and in how many records they stand.

    The step that finds no entry hands the value on, so only unmatched values are shuffled: once to drop rows
    delivered twice, once to count, pre-aggregated.
    """
    shared, rows = _prepared(records, lists, columns, id_column, bound)
    left = rows.mapInPandas(_matching(shared, columns, with_value=True), "id long, field string, ref_id long, value string")
    return left.groupBy("id", "field").agg(F.min("value").alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))
