"""Subject areas of documents: weighted subject terms found by automaton, scored by sentence, calibrated thresholds."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log, log2, sqrt
from random import Random

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Curated general terms of each subject in English, Spanish and Russian; "*" stands for any ending.
CURATED = {
    "navigation": "navigat*, compass*, radar*, nautical chart*, buoy*, lighthouse*, sextant, latitude, longitude, gps, dead reckoning, tidal, brújula, carta náutica, rumbo, marea*, навигац*, компас*, маяк*, лоцман*",
    "engineering": "engine, engines, turbine*, boiler*, piston*, crankshaft*, valve*, weld*, voltage, switchboard*, turbocharg*, hull, generator*, motor*, caldera*, soldad*, двигател*, подшипник*, насос*, генератор*",
    "hospitality": "menu*, guest*, breakfast*, buffet*, waiter*, dessert*, recipe*, linen, banquet*, concierge*, hotel room*, cocktail*, huésped*, cocina*, desayuno*, camarote*, завтрак*, меню, десерт*, гостей",
    "sport_diving": "scuba, snorkel*, wetsuit*, freediv*, nitrox, regatta*, swim*, marathon*, sprint*, football*, goalkeeper*, championship*, athlet*, podium*, buceo, natación, aletas, дайвинг*, регат*, заплыв*",
    "law": "court, courts, lawsuit*, judge*, statute*, litigat*, plaintiff*, defendant*, arbitrat*, liabilit*, jurisdiction*, verdict*, clause*, contrato*, tribunal*, demanda*, cláusula*, договор*, исков*, апелляц*",
    "medicine": "patient*, hospital*, vaccin*, fever*, wound*, disease*, infect*, diagnos*, symptom*, blood pressure, surgeon*, doses, fiebre*, vacuna*, herida*, médic*, прививк*, врач*, лечени*, больниц*",
    "science": "plankton*, photosynthes*, isotop*, sediment*, salinity, hypothes*, laborator*, molecul*, ecosystem*, coral*, glacier*, geolog*, plancton*, arrecife*, sedimento*, salinidad*, планктон*, исследован*, солёност*, коралл*",
    "software": "software, compiler*, server*, database*, source code, algorithm*, firmware, login*, deploy*, encrypt*, router*, api, servidor*, código fuente, contraseña*, base de datos, сервер*, парол*, программн*, исходный код",
    "finance": "invoice*, loan*, tax, taxes, interest rate*, dividend*, stock market*, mortgage*, budget*, accountant*, revenue*, pension*, factura*, impuesto*, préstamo*, nómina*, кредит*, налог*, банковск*, зарплат*",
    "education": "student*, teacher*, exams, exam timetable*, oral exam*, syllabus*, curricul*, homework*, classroom*, pupil*, universit*, scholarship*, essay*, alumno*, examen*, becas, учебн*, экзамен*, стипенди*, студент*",
}
PRIOR, PRIOR_DOCUMENTS = 0.9, 3.0
LEAST_WEIGHT, LEAST_DOCUMENTS, LONGEST_RUN = 0.6, 3, 3
#: Share of sentences from which a document has a subject (TESTDATA.md), and the length up to which a sentence's words don't count against it.
SHARE, PLAIN_WORDS = 0.2, 40
TRIES = tuple(round(0.5 + 0.025 * i, 3) for i in range(15))
_WORD = re.compile(r"[^\W_]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str) -> list[str]:
    """Sentences with their words alone, in lower case between single blanks; pieces without words stay as sentences."""
    low = text.lower()
    if _OTHER_SPACE.search(low):
        pieces = _SENTENCE.split(low)
    else:
        # The same cuts where blanks and line ends are the only white space.
        pieces = low.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
    return [f" {' '.join(_WORD.findall(s))} " for s in pieces if s.strip()]


def _pattern(term: str) -> str:
    """How a term stands in a sentence of words: after a blank, and before one unless its ending is open."""
    return f" {' '.join(_WORD.findall(term))}" + ("" if term.endswith("*") else " ")


def curated_terms(curated: dict[str, str] = CURATED) -> dict[str, dict[str, float]]:
    """pattern -> {subject: prior weight}."""
    out: dict[str, dict[str, float]] = {}
    for subject, text in curated.items():
        for term in text.split(","):
            out.setdefault(_pattern(term.strip()), {})[subject] = PRIOR
    return out


class Finder:
    """One automaton over term patterns; hits are reported by sentence."""

    def __init__(self, patterns: Iterable[str]):
        self.auto = ahocorasick.Automaton()
        for p in patterns:
            if p.strip():
                self.auto.add_word(p, (len(p), p))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def hits(self, said: list[str]) -> Iterator[tuple[int, str]]:
        """(sentence number, pattern) of every hit, in one pass over the sentences joined by line ends."""
        if not self.any or not said:
            return
        starts, at = [], 0
        for s in said:
            starts.append(at)
            at += len(s) + 1
        for last, (n, p) in self.auto.iter("\n".join(said)):
            yield bisect_right(starts, last - n + 1) - 1, p


@dataclass
class Evidence:
    """What a labelled sample says of terms: documents, documents and sentences by term, sentences by term and label."""

    documents: int = 0
    held: Counter = field(default_factory=Counter)
    said: Counter = field(default_factory=Counter)
    agreed: Counter = field(default_factory=Counter)

    def add(self, said: list[str], labels: set[str], finder: Finder) -> None:
        self.documents += 1
        found: dict[str, set[int]] = {}
        for k, s in enumerate(said):
            words = s.split()
            for a in range(len(words)):
                for b in range(a + 1, min(a + LONGEST_RUN, len(words)) + 1):
                    if not words[b - 1].isalpha():
                        break
                    found.setdefault(f" {' '.join(words[a:b])} ", set()).add(k)
        for k, p in finder.hits(said):
            found.setdefault(p, set()).add(k)
        for p, where in found.items():
            self.held[p] += 1
            self.said[p] += len(where)
            for label in labels:
                self.agreed[p, label] += len(where)

    def __add__(self, other: Evidence) -> Evidence:
        return Evidence(self.documents + other.documents, self.held + other.held, self.said + other.said, self.agreed + other.agreed)


def lower_bound(p: float, n: float, z: float = 1.64) -> float:
    """Wilson's lower bound of a share p seen in n documents."""
    return (p + z * z / 2 / n - z * sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def weighted_terms(evidence: Evidence, curated: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """pattern -> {subject: weight}.

    A curated term's weight is its prior, moved by how often the sample's documents with it bear the subject; a
    run of up to three words joins the list where even the lower bound of that share is high and no shorter run
    in it says as much. Both fade by rarity: a term in more than a fifth or so of the documents (n^-0.2) says little.
    """
    def rarity(p: str) -> float:
        n = evidence.documents
        return 1.0 if n < 2 or not evidence.held[p] else min(1.0, log(n / evidence.held[p]) / log(n) / 0.2)

    out: dict[str, dict[str, float]] = {}
    for p, subjects_ in curated.items():
        for s, prior in subjects_.items():
            n = evidence.held[p]
            share = evidence.agreed[p, s] / evidence.said[p] if n else 0.0
            w = (PRIOR_DOCUMENTS * prior + n * share) / (PRIOR_DOCUMENTS + n) * rarity(p)
            if w >= LEAST_WEIGHT:
                out.setdefault(p, {})[s] = w
    found = []
    for (p, s), n in evidence.agreed.items():
        if p.endswith(" ") and evidence.held[p] >= LEAST_DOCUMENTS:
            w = lower_bound(n / evidence.said[p], evidence.held[p]) * rarity(p)
            if w >= LEAST_WEIGHT:
                found.append((p.count(" "), p, s, w))
    for _, p, s, w in sorted(found):
        words = p.split()
        parts = [f" {' '.join(words[a:b])} " for a in range(len(words)) for b in range(a + 1, len(words) + 1) if b - a < len(words)]
        if all(out.get(x, {}).get(s, 0.0) < w - 0.1 for x in parts):
            held = out.setdefault(p, {})
            held[s] = max(w, held.get(s, 0.0))
    return out


class SubjectModel:
    """Weighted terms and, by subject, the least weight from which a sentence deals with it."""

    def __init__(self, terms: dict[str, dict[str, float]], thresholds: dict[str, float] | None = None):
        self.terms, self.thresholds = terms, thresholds or {}
        self.finder: Finder | None = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "thresholds": self.thresholds, "finder": None}

    def sentence_weights(self, text: str) -> tuple[int, dict[tuple[int, str], float]]:
        """(sentences, weight by sentence and subject): the best term's, less where a sentence is very long."""
        self.finder = self.finder or Finder(self.terms)
        said = sentences(text)
        best: dict[tuple[int, str], float] = {}
        for k, p in self.finder.hits(said):
            for s, w in self.terms[p].items():
                if w > best.get((k, s), 0.0):
                    best[k, s] = w
        for k, s in best:
            if len(said[k]) > 4 * PLAIN_WORDS and (n := said[k].count(" ")) > PLAIN_WORDS:
                best[k, s] /= 1 + 0.1 * log2(n / PLAIN_WORDS)
        return len(said), best

    def dealt(self, text: str) -> tuple[int, dict[str, int]]:
        """(sentences, sentences that deal with each subject)."""
        n, weights = self.sentence_weights(text)
        dealt: dict[str, int] = {}
        for (_, s), w in weights.items():
            if w >= self.thresholds.get(s, LEAST_WEIGHT):
                dealt[s] = dealt.get(s, 0) + 1
        return n, dealt

    def topic(self, text: str, share: float = SHARE) -> str | None:
        """The subject that most sentences deal with, at least `share` of them; of equal ones the first by name."""
        n, dealt = self.dealt(text)
        enough = [(-k, s) for s, k in dealt.items() if k >= share * n - 1e-9]
        return min(enough)[1] if enough else None


def calibrate(model: SubjectModel, sample: list[tuple[str, set[str]]], share: float = SHARE) -> dict[str, float]:
    """By subject the sentence threshold with the best F1 on labelled texts; of equally good ones that nearest LEAST_WEIGHT."""
    labelled: Counter = Counter()
    found: dict[str, list[Counter]] = {}
    for text, labels in sample:
        labelled.update(labels)
        n, weights = model.sentence_weights(text)
        by: dict[str, list[float]] = {}
        for (_, s), w in weights.items():
            by.setdefault(s, []).append(w)
        for s, ws in by.items():
            for i, t in enumerate(TRIES):
                if sum(w >= t for w in ws) >= share * n - 1e-9:
                    found.setdefault(s, [Counter() for _ in TRIES])[i][s in labels] += 1
    out = {}
    for s, tries in found.items():
        f1 = [2 * c[True] / max(1, c[True] + c[False] + labelled[s]) for c in tries]
        out[s] = min((t for t, f in zip(TRIES, f1) if f >= max(f1)), key=lambda t: abs(t - LEAST_WEIGHT))
    return out


def fit(documents: DataFrame, labels: DataFrame, bound: int = 3000, longest: int = 20_000, id_column: str = "doc_id", text: str = "text", curated: dict[str, str] = CURATED) -> SubjectModel:
    """A model from at most `bound` labelled documents of at most `longest` characters (the sample's documented bounds).

    Which documents is decided by a hash of the id, the same at any size; the sampled ids, proven to be at most
    `bound`, are broadcast. Terms learned from one half set the thresholds on the other half; the terms of both
    halves are kept. Without labels the curated terms stand with their prior weights. Null ids, texts and
    subjects drop out; labels may be wrong and repeated.
    """
    sample = labels.where("doc_id is not null and subject is not null").groupBy(F.col("doc_id").alias("sampled")).agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("sampled"), "sampled").limit(bound)
    known = documents.where(F.col(id_column).isNotNull() & F.length(text).between(1, longest)).select(F.col(id_column).alias("sampled"), F.col(text).alias("text"))
    rows = {r["sampled"]: (r["text"], set(r["subjects"])) for r in known.join(F.broadcast(sample), "sampled").collect()}
    prior = curated_terms(curated)
    finder = Finder(prior)
    halves = [Evidence(), Evidence()]
    taken: list[list[tuple[str, set[str]]]] = [[], []]
    keys = sorted(rows)
    Random(0).shuffle(keys)
    for i, key in enumerate(keys):
        said, subjects_ = rows[key]
        halves[i % 2].add(sentences(said), subjects_, finder)
        taken[i % 2].append((said, subjects_))
    limits = calibrate(SubjectModel(weighted_terms(halves[0], prior)), taken[1]) if len(rows) >= 200 else {}
    return SubjectModel(weighted_terms(halves[0] + halves[1], prior), limits)


SCORED = "doc_id long, subject string, sentences int, dealt int, share double"


def subject_scores(documents: DataFrame, model: SubjectModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, sentences, dealt, share) for every subject that at least one sentence deals with.

    A map over whole texts with no shuffle; the model is a few thousand terms, bounded by its sample. Null ids
    and texts, and texts without a sentence, give no rows; repeated rows give repeated rows; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, body in zip(frame["doc_id"], frame["text"]):
                n, dealt = shared.value.dealt(body)
                rows += [(doc, s, n, k, k / n) for s, k in dealt.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "sentences", "dealt", "share"])

    known = documents.where(F.col(id_column).isNotNull() & (F.length(text) > 0))
    return known.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SCORED)


def subjects(documents: DataFrame, model: SubjectModel, share: float = SHARE, **how) -> DataFrame:
    """(doc_id, subject): every subject that at least `share` of the sentences deal with; a document twice counts once."""
    # Both sides are ratios of small whole numbers; the slack covers their rounding only.
    return subject_scores(documents, model, **how).where(F.col("share") >= F.lit(share) - 1e-9).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, model: SubjectModel, **how) -> DataFrame:
    """(subject, documents, share): how much of the corpus has each subject."""
    total = documents.where("doc_id is not null").agg(F.count_distinct("doc_id").alias("total"))
    counts = subjects(documents, model, **how).groupBy("subject").agg(F.count("*").alias("documents"))
    return counts.join(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("share"))
