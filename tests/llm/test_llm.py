import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlinspike.llm import boilerplate, canonical, languages, mixing, near_duplicates, packing, subjects
from marlinspike.llm.components import components
from marlinspike.llm.tokens import TOKENIZERS, count_tokens, tokenizer

WORDS = "anchor bridge cabin deck engine fender galley hatch island jetty keel ladder mast nets oar pilot quay rope sail tide".split()


# --- near duplicates


def _texts(seed: int = 1, groups: int = 12) -> list[tuple]:
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(60)]
        for k in range(rnd.randint(1, 4)):
            words = base.copy()
            for _ in range(k * 2):
                words[rnd.randrange(60)] = rnd.choice(WORDS)
            rows.append((len(rows), f"title {g}", " ".join(words), "x"))
        rows.append((len(rows), f"title {g}", " ".join(base), "x"))
    return rows


def _brute(rows, width, threshold, least):
    sets = {}
    for i, title, body, *_ in rows:
        if i is not None and body is not None and len(re.findall(r"[^\W_]+", body)) >= least:
            w = re.findall(r"[^\W_]+", (f"{title}\n{body}" if title is not None else body).lower())
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


SCHEMA = "id long, title string, description string, key string"


def test_pairs_equal_brute_force(spark):
    rows = _texts()
    odd = [(900, None, None, "x"), (901, "t", "", "x"), (902, "t", "too short", "x"), (None, "t", rows[0][2], "x"), (903, None, "long " * 20_000, "x"), (904, None, "long " * 20_000, "x")]
    df = spark.createDataFrame([*rows, *odd, rows[0]], SCHEMA)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, width=3, threshold=0.5, bands=40, rows=4).collect()}
    want = _brute([*rows, *odd], 3, 0.5, 30)
    assert len(want) > 30 and got == want


def test_recall_at_the_threshold_itself(spark):
    """300 pairs of texts of similarity 0.51, which the bands of problem 3's query meet with 0.96 and its sketch passes with 0.99."""
    rnd, rows = random.Random(8), []
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    for g in range(300):
        shared = fresh(105)
        rows += [(2 * g, None, " ".join(shared + fresh(50)), "x"), (2 * g + 1, None, " ".join(shared + fresh(50)), "x")]
    found = near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), width=3, threshold=0.5, bands=48, rows=4)
    got = {tuple(r) for r in found.collect()}
    assert got <= {(2 * g, 2 * g + 1) for g in range(300)} and len(got) >= 0.92 * 300


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates.near_duplicate_pairs(df).count() == 0 and near_duplicates.near_duplicate_groups(df).count() == 0


def test_groups_are_the_components_of_the_pairs(spark):
    rows = _texts(2)
    df = spark.createDataFrame(rows, SCHEMA)
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in _brute(rows, 3, 0.5, 30):
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.id: (r.class_id, r.copies) for r in near_duplicates.near_duplicate_groups(df, width=3, threshold=0.5, bands=40, rows=4).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: find(i) for i in parent}
    assert max(n for _, n in got.values()) == 2


def test_many_copies_are_compared_once(spark):
    base = " ".join(f"w{i}" for i in range(40))
    df = spark.range(3000).select("id", F.lit("t").alias("title"), F.lit(base).alias("description"), F.lit("x").alias("key"))
    r = near_duplicates.near_duplicate_groups(df).agg(F.max("class_id"), F.min("copies"), F.max("text_links")).first()
    assert tuple(r) == (0, 3000, 0)


def test_signature_estimates_and_varies_less_than_independent_hashes():
    rng, est = np.random.default_rng(5), []
    for _ in range(300):
        u = rng.integers(0, 2**63, 150, dtype=np.uint64)
        s = near_duplicates.superminhash([u[:100], u[50:]], 64)
        est.append((s[0] == s[1]).mean())
    assert abs(np.mean(est) - 1 / 3) < 0.01 and np.std(est) < (1 / 3 * 2 / 3 / 64) ** 0.5


def test_each_element_visits_every_slot_once():
    e = np.array([123456789], dtype=np.uint64)
    sig = near_duplicates.superminhash([e], 16)[0]
    assert sorted(int(x >> np.uint64(32)) for x in sig) == list(range(16))


# --- components


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*chain, *star, (5, 3), (7, 7), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and len(got) == 501
    assert components(df.limit(0)).count() == 0


# --- repeated lines


def _site():
    rows = []
    for i in range(40):
        lines = [f"Own line number {chr(97 + i % 26)}{'x' * i}"]
        if i < 20:
            lines += ["Legal notice 123!", "", "SHARE this"]
        elif i < 23:
            lines += ["rare line"]
        rows.append((i, "s", "\n".join(lines)))
    return [*rows, (40, "s", None), (41, "s", ""), (42, None, "Legal notice"), (43, "t", "Legal notice"), rows[0], (None, "s", "Legal notice")]


def test_repeated_lines_equal_a_count(spark):
    rows = _site()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, source_id string, description string, line string")
    key = lambda x: re.sub(r"[\W\d_]+", "", x.lower())
    once = {r[0]: r for r in rows if r[0] is not None}
    want = set()
    for i, s, d in once.values():
        mates = [r for r in once.values() if r[1] == s]
        for n, line in enumerate((d or "").split("\n"), 1):
            support = sum(any(key(x) == key(line) for x in (m[2] or "").split("\n")) for m in mates)
            if s is not None and key(line) and support >= 5 and support >= 0.03 * len(mates):
                want.add((i, n))
    assert {tuple(r) for r in boilerplate.boilerplate_lines(df).collect()} == want and len(want) == 40
    clean = {r.id: (r.text, r.removed_lines) for r in boilerplate.without_boilerplate(df).collect()}
    assert clean[0] == (rows[0][2].split("\n")[0] + "\n", 2) and clean[40] == (None, 0) and clean[42][1] == 0
    blocks = boilerplate.boilerplate_blocks(df).collect()
    assert len(blocks) == 2 and len({b.block for b in blocks}) == 1 and {b.edge_support for b in blocks} == {20}
    assert boilerplate.boilerplate_lines(df.limit(0)).count() == 0


def test_blocks_of_many_lines_and_both_joins(spark, monkeypatch):
    rows = []
    for i in range(30):
        own = [f"own {'x' * i}"]
        # a-b-c always together; d only alone; e after c in four documents, too few for an edge.
        rows.append((i, "s", "\n".join(own + (["a", "---", "b", "c"] if i < 10 else []) + (["e"] if i < 4 or 10 <= i < 20 else []) + (["d", *own] if i > 24 else []))))
    df = spark.createDataFrame(rows, "id long, source_id string, description string")
    got = [sorted((r.support, r.edge_support) for r in rs) for rs in _by_block(boilerplate.boilerplate_blocks(df).collect())]
    assert sorted(got, key=str) == [[(10, 10)] * 3, [(14, None)], [(5, None)]]
    found = {tuple(r) for r in boilerplate.boilerplate_lines(df).collect()}
    monkeypatch.setattr(boilerplate, "BROADCAST_LINES", 0)
    assert {tuple(r) for r in boilerplate.boilerplate_lines(df).collect()} == found and (0, 3) not in found and {(0, 2), (0, 4), (0, 5), (0, 6), (29, 2)} <= found


def _by_block(rows):
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, []).append(r)
    return list(blocks.values())


# --- languages


def test_labels_in_any_notation(spark):
    given = ["en-GB", "English", " DE ", "pt_BR", "ukr", "es-419", "und", "", None, "Klingon"]
    rows = spark.createDataFrame([(x,) for x in given], "x string").select(languages.label_language(F.col("x")).alias("l")).collect()
    assert [r.l for r in rows] == ["en", "en", "de", "pt", "uk", "es", None, None, None, None]


def test_documents_and_lines(spark):
    en, de, ru, latin = "The crew will work with the chief and travel is paid by the company every month", "Die Mannschaft arbeitet auf dem Schiff und der Vertrag wird für sechs Monate bezahlt", "Экипаж будет работать на судне, дорога оплачивается, контракт на шесть месяцев", "ekipazh budet rabotat' na sudne, doroga oplachivaetsya, kontrakt na shest' mesyatsev"
    rows = [(1, f"{en}\n{en}\n{de}", "en"), (2, f"{de}\n{de}", "en"), (3, f"{latin}\n{latin}", None), (4, f"{ru}\nhttps://x.example/abc\n=====\n12", "ru"), (5, None, "en"), (6, "", "en"), (7, "12 %%", "en"), (2, f"{de}\n{de}", "en"), (None, en, "en"), (8, (en + " ") * 500, "eng")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, description string, language string, lang string")
    known = spark.createDataFrame([(100 + i, text, code) for i, (code, text) in enumerate(languages.SEEDS.items())], "id long, description string, language string")
    model = languages.train(known)
    got = {tuple(r) for r in languages.language_errors(df, model=model).collect()}
    assert got == {(1, 3, "de"), (2, 0, "de"), (3, 0, "ru")}
    sure = {(r.id, r.line_no): r.confidence for r in languages.languages(df, model=model).collect()}
    assert sure[2, 0] == 1.0 and 0.5 < sure[1, 0] < 1.0 and 0 < sure[1, 3] <= 1.0
    assert languages.languages(df.limit(0)).count() == 0
    assert languages.main_languages(["", "12 %", en], model.weights) == [None, None, "en"] and languages.main_languages([], model.weights) == []


#: Sentences from elsewhere, two of each language.
ELSEWHERE = {
    "en": ["The library opens at nine and closes when the last reader has gone home.", "My grandmother used to bake bread with walnuts on Sundays."],
    "de": ["Die Bibliothek öffnet um neun Uhr und schließt, wenn der letzte Leser gegangen ist.", "Meine Großmutter hat sonntags oft Brot mit Walnüssen gebacken."],
    "nl": ["De bibliotheek gaat om negen uur open en sluit als de laatste lezer naar huis is.", "Mijn grootmoeder bakte op zondag vaak brood met walnoten."],
    "fr": ["La bibliothèque ouvre à neuf heures et ferme quand le dernier lecteur est parti.", "Ma grand-mère faisait souvent du pain aux noix le dimanche."],
    "es": ["La biblioteca abre a las nueve y cierra cuando se ha ido el último lector.", "Mi abuela solía hacer pan con nueces los domingos."],
    "pt": ["A biblioteca abre às nove horas e fecha quando o último leitor vai embora.", "A minha avó costumava fazer pão com nozes aos domingos, não é verdade?"],
    "pl": ["Biblioteka jest otwierana o dziewiątej i zamykana, gdy wyjdzie ostatni czytelnik.", "Moja babcia często piekła w niedziele chleb z orzechami."],
    "ru": ["Библиотека открывается в девять часов и закрывается, когда уходит последний читатель.", "Моя бабушка часто пекла по воскресеньям хлеб с орехами."],
    "uk": ["Бібліотека відчиняється о дев'ятій годині і зачиняється, коли піде останній читач.", "Моя бабуся часто пекла щонеділі хліб з горіхами."],
}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_languages_of_sentences_from_elsewhere(spark):
    model = languages.train(spark.read.parquet("/root/testdata/sf0.1/normalized_opportunities.parquet"))
    texts, codes = zip(*[(t, code) for code, ts in ELSEWHERE.items() for t in ts])
    assert sum(a == b for a, b in zip(languages.main_languages(list(texts), model.weights), codes)) >= 17


# --- free values

PLACES = [(1, "Nordland", [], "country", "Nordland"), (2, "Ostreich-Weston", [], "country", "Ostreich-Weston"), (3, "Karmelvik", ["Old Karm"], "port", "Nordland"), (4, "Twinport", [], "port", "Nordland"), (5, "Twinport", [], "port", "Ostreich-Weston"), (6, "Sunder Sea", [], "region", None), (7, "Worldwide", ["Global"], "region", None), (8, "Melgar Gulf", [], "region", None)]
JOBS = [(50, "Chief Officer", ["Chief Mate"], "entry", None), (51, "Chief Engineer", [], "entry", None), (52, "Third Officer", [], "entry", None), (53, "Wiper", [], "entry", None)]


@pytest.mark.parametrize(
    ("value", "ref"),
    [("Port of KARMELVIK", 3), ("Karmelvík, Nordland, NA", 3), ("near Karmlevik", 3), ("Old Karm anchorage", 3), ("Twinport (Ostreich-Weston)", 5), ("Nordland: Tw1nport", 4), ("Ostriech-Weston/Melba Agency", 2), ("Melba Manning (Nordlnad)", 1), ("the Sundder Sea area", 6), ("World-wide", 7), ("Pelgonor Bay", -1), ("Head office", -1), ("Gate Nordland New terminal", 1), ("Gulf Melgar terminal", 8), ("terminal of Mellgar, the Gulf", 8), ("Kar melvvik", 3), ("", -1), ("-", -1), ("z" * 50_000, -1)],
)
def test_places(value, ref):
    assert canonical.Matcher(PLACES).place(value) == ref


@pytest.mark.parametrize(
    ("value", "ref"),
    [("#12 Chief Mates", 50), ("URGENT: ChiefOfficer, 3 months", 50), ("Officer, Third – Melba Star", 52), ("3rd Off.", 52), ("Cheif Engieneer for Melba Dawn", 51), ("Wiper (m/f/x)", 53), ("Lighthouse poet in residence", -1), ("", -1), ("x" * 50_000, -1)],
)
def test_titles(value, ref):
    assert canonical.Matcher(JOBS).title(value) == ref


def _all_pairs_like(sets, words):
    """TokenSets.like() without its index: every word against every token."""
    out = {}
    for i, p in enumerate(sets.phrases):
        met = {}
        for t in set(p.split()):
            for w in words:
                most = max(1, round(sets.tolerance * len(t)))
                d = 0 if w == t else canonical.osa(w, t, most) if min(len(w), len(t)) >= 3 else most + 1
                if d <= most:
                    met[t] = max(met.get(t, 0.0), 1 - d / max(len(t), len(w)))
        share = sum(sets.weight[t] * x for t, x in met.items()) / sets.total[i]
        if share >= 1 - sets.tolerance - 1e-9:
            out[p] = (round(share, 9), len(met) == len(set(p.split())))
    return out


def test_token_index_finds_what_comparing_everything_finds():
    rnd = random.Random(6)
    name = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    phrases = [" ".join([name(), *rnd.choice([[], ["port"], [name()], ["gulf"]])]) for _ in range(150)]
    sets = canonical.TokenSets(list(dict.fromkeys(phrases)), 0.34)
    hits = 0
    for _ in range(400):
        letters = list(rnd.choice(phrases))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(letters))
            how = rnd.randrange(4)
            if how == 0:
                del letters[at]
            elif how == 1:
                letters.insert(at, rnd.choice("abkz"))
            elif how == 2:
                letters[at] = rnd.choice("abkz")
            elif at:
                letters[at - 1], letters[at] = letters[at], letters[at - 1]
        words = "".join(letters).split()
        rnd.shuffle(words)
        got = {p: (round(x, 9), whole) for x, p, _, whole in sets.like(words)}
        want = _all_pairs_like(sets, words)
        hits += len(want)
        assert got == want
    assert hits > 300


def test_edit_distance_counts_swaps():
    assert canonical.osa("abcd", "abdc", 3) == 1 and canonical.osa("abc", "xyz", 2) == 3 and canonical.osa("", "ab", 2) == 2


def test_values_of_all_rows(spark):
    df = spark.createDataFrame([(1, "Karmelvik", None, "x"), (1, "Karmelvik", None, "x"), (2, None, "Wiper", "x"), (3, "", "zzz", "x"), (None, "Karmelvik", "Wiper", "x")], "id long, place string, job string, ref_id string")
    places = spark.createDataFrame(PLACES, "ref_id long, name string, aliases array<string>, place_kind string, country string")
    jobs = spark.createDataFrame([x[:3] for x in JOBS], "ref_id long, name string, aliases array<string>")
    how = {"place": ("p", "place"), "job": ("j", "title")}
    got = sorted(tuple(r) for r in canonical.canonical_values(df, {"p": places, "j": jobs}, how).collect())
    assert got == [(1, "place", 3), (2, "job", 53), (3, "job", -1), (3, "place", -1)]
    assert {r.ref_id for r in canonical.canonical_values(df, {"p": places.limit(0), "j": jobs.limit(0)}, how).collect()} == {-1}
    with pytest.raises(ValueError):
        canonical.canonical_values(df, {"p": places, "j": jobs}, how, bound=2)
    assert {tuple(r) for r in canonical.unmatched_values(df, {"p": places, "j": jobs}, how).collect()} == {("job", "zzz", 1), ("place", "", 1)}


# --- packing


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(np.arange(1, 60), n, replace=False)), rng.integers(1, 9, n), int(rng.integers(1, 6))
        cost = lambda b: sum(c * (b[np.searchsorted(b, x)] - x) for x, c in zip(lengths, counts))  # noqa: B023, E731
        got = packing.optimal_buckets(lengths, counts, k)
        best = min(cost(np.array(sorted({*cut, lengths[-1]}))) for r in range(min(k, n)) for cut in itertools.combinations(lengths[:-1], r))
        assert len(got) <= k and cost(got) == best


def test_containers_hold_each_text_once_and_whole(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 5, 40, 41, 77, 100, 130, 355])) for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(sizes, "id long, tokens long")
    rows = [r for r in packing.pack(df, {"small": 100, "large": 1000}, buckets=4, rows_per_task=50).collect() if r.pack_name == "small"]
    placed = [r for r in rows if r.container is not None]
    fill, seats, pieces = {}, set(), {}
    for r in placed:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert (r.container, r.place) not in seats
        seats.add((r.container, r.place))
        pieces.setdefault(r.id, []).append((r.piece, r.tokens))
    assert max(fill.values()) <= 100 and all(100 - fill[r.container] == r.unused for r in placed)
    assert sorted(fill) == list(range(len(fill)))
    for i, n in sizes:
        if n:
            parts = sorted(pieces[i])
            assert [p for p, _ in parts] == list(range(1, len(parts) + 1)) and sum(t for _, t in parts) == n and len(parts) == -(-n // 100)
    assert {r.id for r in rows if r.container is None} == {i for i, n in sizes if not n}
    plans = packing.plan_packs(df, {"small": 100})
    share = packing.unused_space(packing.pack(df, {"small": 100}, plans=plans), plans).first()
    assert share.tokens == sum(n or 0 for _, n in sizes) and share.unused_share < 0.15 and share.inside_unused_share > share.unused_share
    assert packing.pack(df.limit(0), {"small": 100}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {"none": 0})


def test_batches_inside_their_buckets(spark):
    df = spark.createDataFrame([(i, 30 if i % 2 else 60) for i in range(100)], "id long, tokens long")
    plans = packing.plan_packs(df, {"p": 100}, top_up=False)
    inside = packing.unused_space(packing.pack(df, {"p": 100}, plans=plans), plans).first()
    assert inside.containers == 50 + 17 and inside.unused_share == inside.inside_unused_share and inside.padding_share == 0
    plans = packing.plan_packs(df, {"p": 100})
    assert packing.unused_space(packing.pack(df, {"p": 100}, plans=plans), plans).first().containers == 50


def test_one_length_for_all(spark):
    rows = packing.pack(spark.range(1000).select("id", F.lit(30).cast("long").alias("tokens")), {"p": 100}, rows_per_task=100)
    assert rows.select("container").distinct().count() == 334 and rows.groupBy("container").count().agg(F.max("count")).first()[0] == 3


@pytest.mark.skipif(not __import__("os").path.isdir(TOKENIZERS), reason="no vocabulary files here")
def test_tokens_round_trip(spark):
    texts = ["Hello crew, it's 12 o'clock", "", None, "Привет, экипаж", "a" * 50_000, "<|endoftext|>"]
    enc = tokenizer()
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "x", "x")], "doc_id long, text string, tokens string")
    got = {r.id: r.tokens for r in count_tokens(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    first = count_tokens(df, features={"first": lambda ts: [t[:1] or None for t in ts]}).collect()
    assert {r.id: (r.first, r.tokens) for r in first} == {i: ((t or "")[:1] or None, got[i]) for i, t in enumerate(texts)}


# --- mixing


def test_shares_and_caps(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice("aaaaabc"), rnd.choice(["en", "de", None]), None, rnd.randint(5, 60)) for i in range(3000)] + [(9000, "z", "en", None, 50), (9001, None, "en", None, 50), (9002, "a", "en", None, 0)]
    df = spark.createDataFrame(docs, "id long, source string, lang string, doc_kind string, tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2), ("empty", 0.0, 1)], "source string, target_share double, max_repeats int")
    size, most = dict((d[0], d[4]) for d in docs), {"a": 1, "b": 3, "c": 2}
    held = {s: sum(d[4] for d in docs if d[1] == s) for s in "abc"}

    def drawn(**how):
        rows, by = mixing.mix(df, targets, ("lang", "doc_kind"), **how).collect(), {}
        assert len(rows) == len({r.id for r in rows})
        for r in rows:
            assert 1 <= r.copies <= most[r.source] and r.tokens == size[r.id]
            by[r.source] = by.get(r.source, 0) + r.copies * r.tokens
        return by

    by = drawn(exact=True)
    for s, share in (("a", 0.2), ("b", 0.5), ("c", 0.3)):
        assert by[s] / sum(by.values()) == pytest.approx(share, abs=0.001)
    assert sum(by.values()) == pytest.approx(min(3 * held["b"] / 0.5, 2 * held["c"] / 0.3, held["a"] / 0.2), rel=0.01)
    # As large as the corpus: b and c give all they may, a fills up.
    by = drawn()
    assert by["b"] == 3 * held["b"] and by["c"] == 2 * held["c"] and by["a"] == pytest.approx(sum(held.values()) - by["b"] - by["c"], rel=0.01)
    report = {r.source: r for r in mixing.shares(mixing.mix(df, targets, ("lang", "doc_kind"), total=1e9), targets).collect()}
    assert report["b"].most_copies == 3 and report["empty"].tokens == 0
    assert mixing.mix(df.limit(0), targets, ("lang", "doc_kind")).count() == 0


def test_one_tiny_source_does_not_shrink_the_mixture(spark):
    docs = [(i, "ab"[i % 2], "en", "law", 20 + i % 7) for i in range(2000)] + [(5000, "tiny", None, None, 30)]
    df = spark.createDataFrame(docs, "id long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.2, 1), ("tiny", 0.4, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.shares(mixing.mix(df, targets), targets).collect()
    by, whole = {r.source: r for r in rows}, sum(d[4] for d in docs)
    assert sum(r.tokens for r in rows) == pytest.approx(whole, rel=0.01) and by["tiny"].tokens == 30
    assert by["a"].tokens == pytest.approx(2 * by["b"].tokens, rel=0.01)


def test_raking_meets_all_marginals_without_caps():
    tokens = np.array([10.0, 20, 30, 40])
    g0, g1 = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    w = mixing.rake(tokens, [g0, g1], [np.array([60.0, 40]), np.array([50.0, 50])], np.full(4, 100.0))
    assert np.bincount(g0, w * tokens) == pytest.approx([60, 40]) and np.bincount(g1, w * tokens) == pytest.approx([50, 50], abs=1e-6)


# --- subjects

SEA, PLAIN = "Nothing surprised us more than plankton samples.", "The weather held for 5 days."


def test_subjects_by_share_of_sentences(spark):
    rows = [(1, " ".join([SEA] + [PLAIN] * 4)), (2, " ".join([SEA] + [PLAIN] * 5)), (3, "She learned PLANKTON samples the hard way. The tribunal\nmet"), (4, ""), (5, None), (6, "The planks of the courtesy boat."), (7, (SEA + "\n") * 5000), (1, " ".join([SEA] + [PLAIN] * 4)), (None, SEA), (8, " \n ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, subject string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    model = subjects.fit(df, none)
    assert {tuple(r) for r in subjects.subjects(df, model).collect()} == {(1, "science"), (3, "science"), (3, "law"), (7, "science")}
    assert subjects.subjects(df.limit(0), subjects.fit(df.limit(0), none)).count() == 0
    assert {r.subject: r.documents for r in subjects.composition(df, model).collect()} == {"science": 3, "law": 1}


def test_terms_are_learned_weighed_and_thresholds_calibrated(spark):
    rnd, rows, labels = random.Random(4), [], []
    for i in range(800):
        topic = {0: ("science", "the murky gyre"), 1: ("law", "the parchment seal")}.get(i % 10)
        # "court" stands anywhere, so it says nothing; a third of the documents only mention their term.
        few, n = i % 3 == 0, rnd.randint(1, 6)
        own = [f"On day {i} we saw {topic[1]} again"] * (1 if few else n) if topic else []
        rows.append((i, ". ".join(own + ["The court yard was wet"] * (9 if few else n) + ["It rained"])))
        if not few and topic:
            labels.append((i, topic[0]))
        elif not topic:
            labels.append((i, "other"))
    df, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, "law"), (9999, None), (9998, "law")], "doc_id long, subject string")
    model = subjects.fit(df, named)
    assert model.terms[" gyre "]["science"] > 0.9 and " court " not in model.terms and " we saw the " not in model.terms
    assert {"science", "law"} <= set(model.thresholds)
    assert {tuple(r) for r in subjects.subjects(df, model).where("subject <> 'other'").collect()} == {x for x in labels if x[1] != "other"}


OUTSIDE = {
    "navigation": "The navigator took a sextant sight and worked out the latitude. A lighthouse gave one line of position. The compass was checked at noon.",
    "engineering": "Steam from the boiler drives the turbine. Each piston turns the crankshaft through a rod. A worn valve lowers the pressure.",
    "hospitality": "Guests choose from the menu until ten. A waiter brings the dessert. The breakfast room is on the second floor.",
    "sport_diving": "The football team won the championship in extra time. Their goalkeeper saved a penalty. The swimmers finished second.",
    "law": "The court ruled that the defendant had broken the agreement. The plaintiff may appeal the verdict. A judge will hear the lawsuit in May.",
    "medicine": "The patient came to the hospital with a fever. The surgeon cleaned the wound. No other symptoms were seen.",
    "science": "Photosynthesis turns light into chemical energy. The hypothesis was tested in a laboratory. Two molecules of water are split.",
    "software": "The compiler turns source code into machine instructions. A bug in the database driver broke the login. The server was deployed again.",
    "finance": "The bank raised its interest rates twice. Investors expect a smaller dividend. Taxes on revenue will rise.",
    "education": "Students hand in their essays on Friday. The teacher marks the homework. A new curriculum starts at the university.",
}


@pytest.mark.parametrize("subject", OUTSIDE)
def test_texts_from_elsewhere(subject):
    assert subjects.SubjectModel(subjects.curated_terms()).topic(OUTSIDE[subject]) == subject


def test_scores_do_not_depend_on_how_pieces_are_batched(monkeypatch):
    model = languages.LineModel.fit([(s, code) for code, t in languages.SEEDS.items() for s in languages.both_spellings(t, code)])
    pieces = [*languages.SEEDS.values(), "", "12", "x", *(t * 30 for t in languages.SEEDS.values())]
    sums, letters = model.score(pieces)
    for chunk in (1, 50, 3000):
        monkeypatch.setattr(languages, "CHUNK", chunk)
        again, n = model.score(pieces)
        assert np.allclose(again, sums) and (n == letters).all()
    assert [languages.LANGUAGES[i] for i in sums.argmax(axis=1)[:9]] == list(languages.SEEDS) and letters[9] == letters[10] == 0 and letters[11] <= 1
