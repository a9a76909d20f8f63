"""Missing or wrong language labels: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "ru", "uk", "es", "pt", "de", "nl", "fr", "pl")
#: Usual names of the languages beside their two-letter codes; fixed values.
LABEL_NAMES = {
    "en": ["eng", "english"],
    "ru": ["rus", "russian", "русский"],
    "uk": ["ukr", "ukrainian", "українська", "ua"],
    "es": ["spa", "spanish", "español", "castellano"],
    "pt": ["por", "portuguese", "português"],
    "de": ["deu", "ger", "german", "deutsch"],
    "nl": ["nld", "dut", "dutch", "nederlands"],
    "fr": ["fra", "fre", "french", "français"],
    "pl": ["pol", "polish", "polski"],
}
#: The first article of the Universal Declaration of Human Rights (fixed values) and two everyday sentences in each language, so that one without any labelled document isn't unknown.
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Yesterday evening we walked along the river and talked about the children, the weather and what to cook for dinner. My brother comes by train tomorrow morning if it does not snow.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Вчера вечером мы гуляли вдоль реки и говорили о детях, о погоде и о том, что приготовить на ужин. Завтра утром брат приедет на поезде, если не будет снега.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Учора ввечері ми гуляли вздовж річки й розмовляли про дітей, про погоду та про те, що приготувати на вечерю. Завтра вранці брат приїде потягом, якщо не буде снігу.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Ayer por la tarde paseamos junto al río y hablamos de los niños, del tiempo y de lo que íbamos a cocinar para la cena. Mañana temprano llega mi hermano en tren, si no nieva.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Ontem à tarde passeamos junto ao rio e falamos das crianças, do tempo e do que íamos cozinhar para o jantar. Amanhã cedo chega o meu irmão de comboio, se não nevar.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Gestern Abend gingen wir am Fluss spazieren und sprachen über die Kinder, das Wetter und was wir zum Essen kochen wollten. Morgen früh kommt mein Bruder mit dem Zug, wenn es nicht schneit.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Gisteravond wandelden we langs de rivier en praatten we over de kinderen, het weer en wat we zouden koken. Morgenvroeg komt mijn broer met de trein, als het niet sneeuwt.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Hier soir nous nous sommes promenés au bord de la rivière et nous avons parlé des enfants, du temps et de ce que nous allions préparer pour le dîner. Demain matin mon frère arrive en train, s'il ne neige pas.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Wczoraj wieczorem spacerowaliśmy wzdłuż rzeki i rozmawialiśmy o dzieciach, o pogodzie i o tym, co ugotować na kolację. Jutro rano brat przyjedzie pociągiem, jeśli nie będzie śniegu.",
}
#: Latin spelling of Cyrillic letters; fixed values.
LATIN = dict(zip("абвгдезийклмнопрстуфыэіґ", "a b v g d e z i y k l m n o p r s t u f y e i g".split())) | {
    "ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "'", "ю": "yu", "я": "ya", "ї": "yi", "є": "ye",
}
LATIN_UK = LATIN | {"г": "h", "и": "y", "й": "i", "х": "kh", "ь": ""}

BITS = 15
CHUNK = 200_000
_NOISE = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+|\b[\w-]+(?:\.[\w-]+)*\.(?!\d)[^\W\d_]{2,24}(?:[/:?]\S*|\b(?=\s|$|[.,;)]))")
_LETTER = np.zeros(0x110000, dtype=bool)
for _lo, _hi in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x370, 0x530), (0x530, 0x600), (0x1E00, 0x2000)):
    _LETTER[_lo:_hi] = True
_LETTER[[0xD7, 0xF7]] = False


def label_language(label: Column) -> Column:
    """The language a label names in any usual notation (code, three-letter code, name, region or script added), else null."""
    pairs = [F.lit(x) for code, names in LABEL_NAMES.items() for name in (code, *names) for x in (name, code)]
    plain = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), plain), F.try_element_at(F.create_map(*pairs), F.regexp_extract(plain, r"^([^\s_-]+)", 1)))


#: What a line with an address in it has; the sign stands first, so that the search skips other letters.
_DOTTED = re.compile(r"\.\w|[@/]")


def _clean(line: str) -> str:
    """Lower case, without web and mail addresses."""
    return _NOISE.sub(" ", line).lower() if _DOTTED.search(line) else line.lower()


def _codes(text: str) -> np.ndarray:
    """Code points with everything but letters as blanks."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    c[~_LETTER[np.minimum(c, 0x10FFFF)]] = 32
    return c


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of the hashed three-letter runs, word edges included; runs about a blank don't count."""
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    at = np.flatnonzero(c[1:-1] != 32)
    with np.errstate(over="ignore"):
        h = (c[at] * np.uint32(0x9E3779B1) + c[at + 1]) * np.uint32(0x85EBCA77) + c[at + 2]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    return at, (h >> np.uint32(32 - BITS)).astype(np.int32)


class LineModel:
    """Log-probabilities of gram buckets per language; the matrix is what gets broadcast (2^15 x 9 floats)."""

    def __init__(self, weights: np.ndarray, languages: tuple[str, ...] = LANGUAGES):
        self.weights, self.languages = weights, languages

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], smooth: float = 0.05) -> LineModel:
        """Gram shares by language, mixed with `smooth` of an even spread: what none has seen says the same of all, however much text each has."""
        counts = np.zeros((1 << BITS, len(LANGUAGES)), dtype=np.float64)
        for i, lang in enumerate(LANGUAGES):
            joined = "\n".join(t for t, l in samples if l == lang)
            counts[:, i] += np.bincount(_grams(_codes(f" {joined.lower()} "))[1], minlength=1 << BITS)
        p = (1 - smooth) * counts / np.maximum(1, counts.sum(axis=0)) + smooth / len(counts)
        w = np.log(p)
        return cls((w - w.mean(axis=1, keepdims=True)).astype(np.float32))

    def score(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods, letters) of each piece, in one sparse pass over all of them."""
        sums, letters = np.zeros((len(pieces), len(self.languages))), np.zeros(len(pieces), dtype=np.int64)
        sizes = np.array([len(p) + 2 for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(pieces):
            # Pieces of some CHUNK letters at a time bound the memory, however long the texts are.
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + CHUNK, "right")))
            at, bucket = _grams(_codes("".join(f" {p} " for p in pieces[lo:hi])))
            owner = np.repeat(np.arange(lo, hi), sizes[lo:hi])[at + 1]
            for b in range(0, len(owner), CHUNK):
                own = owner[b : b + CHUNK]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[first]] += np.add.reduceat(self.weights[bucket[b : b + CHUNK]], first, axis=0, dtype=np.float64)
                letters[own[first]] += np.diff(first, append=len(own))
            lo = hi
        return sums, letters


def both_spellings(text: str, lang: str) -> list[str]:
    """The text, and for a Cyrillic language its Latin spelling too."""
    if lang not in ("ru", "uk"):
        return [text]
    low = text.lower()
    tables = (LATIN,) if lang == "ru" else (LATIN, LATIN_UK)
    return [text, *(low.translate({ord(k): v for k, v in t.items()}) for t in tables)]


def train(documents: DataFrame, text: str = "description", label: str = "language", per_language: int = 400, id_column: str = "id") -> LineModel:
    """A model from at most `per_language` labelled documents of 40 to 20,000 characters of each language (the sample's bound).

    Which documents is decided by a hash of the id, the same at any size; the window keeps its limit on the map
    side, so the shuffle is bounded too. Labels may be wrong: a first model trained on whole documents relabels
    every line of the sample, a second one is trained on the relabelled lines, with the seed sentences in both.
    """
    named = documents.where(F.col(id_column).isNotNull() & F.length(text).between(40, 20_000)).select(F.col(id_column).alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("lang")).where("lang is not null")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = [(r["text"], r["lang"]) for r in named.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("text", "lang").collect()]
    seeds = [(s, lang) for lang, text in SEEDS.items() for s in both_spellings(text, lang)] * 3
    # A Cyrillic label on a Latin-script document would teach Latin words a Cyrillic language's name; scripts decide between the spellings.
    first = LineModel.fit(seeds + [(s, lang) for t, lang in sample for s in both_spellings(t, lang)])
    model = first
    for _ in range(2):
        lines = [(x, lang) for t, lang in sample for x in t.split("\n") if len(x) >= 20]
        sums, letters = model.score([_clean(x) for x, _ in lines])
        best, order = sums.argmax(axis=1), np.sort(sums, axis=1)
        agrees = np.array([LANGUAGES[b] == lang for b, (_, lang) in zip(best, lines)], dtype=bool)
        sure = (letters >= 15) & (agrees | (order[:, -1] - order[:, -2] > 25))
        again = [(s, LANGUAGES[b]) for (x, _), b, ok in zip(lines, best, sure) if ok for s in both_spellings(x, LANGUAGES[b])]
        model = LineModel.fit(seeds + again)
    return model


class ScoredLines:
    """The lines of some texts with their likeliest languages, and each text's main language: that with most letters."""

    def __init__(self, model: LineModel, texts: list[str]):
        pieces, doc, number = [], [], []
        for i, text in enumerate(texts):
            for k, line in enumerate(text.split("\n"), 1):
                if line:
                    pieces.append(_clean(line))
                    doc.append(i)
                    number.append(k)
        self.docs, self.numbers = np.array(doc, dtype=np.int64), np.array(number, dtype=np.int32)
        self.sums, self.letters = model.score(pieces)
        self.best = self.sums.argmax(axis=1)
        self.per = np.zeros((len(texts), len(LANGUAGES)), dtype=np.int64)
        np.add.at(self.per, (self.docs, self.best), self.letters)
        self.total, self.main = self.per.sum(axis=1), self.per.argmax(axis=1)


def main_languages(texts: list[str], weights: np.ndarray) -> list[str | None]:
    """The main language of each text, None where it has no letters."""
    model, out = LineModel(weights), []
    for lo in range(0, len(texts), 2000):
        scored = ScoredLines(model, texts[lo : lo + 2000])
        out += [LANGUAGES[m] if t else None for m, t in zip(scored.main, scored.total)]
    return out


def _label(model_weights, least_letters: int, margin: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LineModel(model_weights.value)
        for frame in frames:
            for lo in range(0, len(frame), 2000):
                part = frame.iloc[lo : lo + 2000]
                of = ScoredLines(model, part["text"].tolist())
                if not len(of.docs):
                    continue
                gap = of.sums[np.arange(len(of.best)), of.best] - of.sums[np.arange(len(of.best)), of.main[of.docs]]
                odd = (of.best != of.main[of.docs]) & (of.letters >= least_letters) & (gap >= margin)
                spread = np.exp(np.clip((of.sums - of.sums.max(axis=1, keepdims=True)) / np.maximum(1.0, np.sqrt(of.letters))[:, None], -50, 0))
                sure = 1 / spread.sum(axis=1)
                whole = np.flatnonzero(of.total > 0)
                share = of.per[whole, of.main[whole]] / of.total[whole]
                ids, named = part["id"].to_numpy(), part["lang"].to_numpy()
                at = np.flatnonzero(odd)
                names = np.array(LANGUAGES, dtype=object)
                yield pd.DataFrame(
                    {
                        "id": np.concatenate([ids[whole], ids[of.docs[at]]]),
                        "line_no": np.concatenate([np.zeros(len(whole), dtype=np.int32), of.numbers[at]]),
                        "lang": np.concatenate([names[of.main[whole]], names[of.best[at]]]),
                        "confidence": np.concatenate([share, sure[at]]),
                        "labelled": np.concatenate([named[whole], np.full(len(at), None, dtype=object)]),
                    }
                )

    return run


def languages(documents: DataFrame, text: str = "description", label: str = "language", id_column: str = "id", model: LineModel | None = None, least_letters: int = 8, margin: float = 4.0) -> DataFrame:
    """(id, line_no, lang, confidence, labelled): line 0 is the document's main language, others are lines in another one.

    The main language has most letters over the lines; its confidence is its share of the letters, a line's is
    its tempered posterior. labelled is the language the label names, null if none. A line counts as being in
    another language if it has at least `least_letters` letters outside addresses and beats the main language by
    `margin` in log-likelihood. Texts without letters, null texts and null ids give no rows; a document
    delivered twice counts once; whole texts are read, however long; one pass without a shuffle before the
    result's own.
    """
    model = model or train(documents, text, label, id_column=id_column)
    shared = documents.sparkSession.sparkContext.broadcast(model.weights)
    rows = documents.where(F.col(id_column).isNotNull() & (F.length(text) > 0)).select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("lang"))
    return rows.mapInPandas(_label(shared, least_letters, margin), "id long, line_no int, lang string, confidence double, labelled string").dropDuplicates(["id", "line_no"])


def language_errors(documents: DataFrame, **how) -> DataFrame:
    """(id, line_no, lang): documents whose label is missing or wrong, and lines in another language."""
    return languages(documents, **how).where("line_no > 0 or labelled is null or labelled <> lang").select("id", "line_no", "lang")
