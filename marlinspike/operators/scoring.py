"""Explainable match score of (profile, posting) pairs: three outcomes per factor, unknowns left out of the share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.vocab import STAGE_LEVELS

MATCH, MISMATCH, NOT_COMPARABLE = "match", "mismatch", "not_comparable"
TRAINING_UNKNOWN, OFFICE_UNKNOWN = "training_offer_signal_unavailable", "hiring_office_not_normalised"
#: A factor makes one verdict from a pair: profile struct and posting struct in, verdict struct out.
Factor = Callable[[Column, Column], Column]


def _none() -> Column:
    return F.lit(None).cast("string")


def cite(field: Column, is_list: bool = False) -> Column:
    """Evidence of a derived value: "value: quote [provenance]", list items joined by commas; without a quote the value alone."""
    def with_quote(value: Column) -> Column:
        quote = F.try_element_at(field["quotes"], value)
        return F.when(quote.isNotNull(), F.concat(value, F.lit(": "), quote)).otherwise(value)

    text = F.array_join(F.transform(field["value"], with_quote), ", ") if is_list else with_quote(field["value"].cast("string"))
    return F.when(field.isNotNull(), F.concat(text, F.lit(" ["), field["provenance"], F.lit("]")))


#: A shortfall that the posting itself closes; it becomes "not comparable".
TRAINED = "trained"


def verdict(factor: str, outcome: Column, theirs: Column, ours: Column, their_text: Column, our_text: Column, caveats: Column | None = None, on_mismatch: str | None = None) -> Column:
    """What a factor found, before weights: each expression stands here once, score() derives the rest from it."""
    return F.struct(
        F.lit(factor).alias("factor"),
        outcome.alias("outcome"),
        theirs.cast("double").alias("theirs"),
        ours.cast("double").alias("ours"),
        their_text.cast("string").alias("posting_evidence"),
        our_text.cast("string").alias("profile_evidence"),
        (caveats if caveats is not None else F.lit(None).cast("array<string>")).alias("caveats"),
        F.lit(on_mismatch).cast("string").alias("on_mismatch"),
    )


def _finish(v: Column) -> Column:
    """A verdict with its weight: the product of both confidences (1 where unknown), 0 if not comparable."""
    none = F.array().cast("array<string>")
    out = F.when(v["outcome"] == TRAINED, NOT_COMPARABLE).otherwise(v["outcome"])
    return F.struct(
        v["factor"].alias("factor"),
        out.alias("outcome"),
        F.when(v["outcome"].isin(MATCH, MISMATCH), F.coalesce(v["theirs"], F.lit(1.0)) * F.coalesce(v["ours"], F.lit(1.0))).otherwise(0.0).alias("weight"),
        F.when(v["outcome"] == TRAINED, "internship: training is part of the offer").otherwise(v["posting_evidence"]).alias("posting_evidence"),
        v["profile_evidence"].alias("profile_evidence"),
        F.when((v["outcome"] == MISMATCH) & v["on_mismatch"].isNotNull(), F.array(v["on_mismatch"])).otherwise(F.coalesce(v["caveats"], none)).alias("caveats"),
    )


def _lower(values: Column) -> Column:
    return F.transform(values, F.lower)


def _empty(fact: Column) -> Column:
    return fact.isNull() | fact["value"].isNull() | (F.size(fact["value"]) == 0)


def membership(factor: str, posting_field: str, profile_field: str) -> Factor:
    """One value of the posting against the person's acceptable ones; no preference is nothing to compare."""

    def make(p: Column, o: Column) -> Column:
        theirs, ours = o[posting_field], p[profile_field]
        out = F.when(theirs.isNull() | _empty(ours), NOT_COMPARABLE).when(F.array_contains(_lower(ours["value"]), F.lower(theirs["value"])), MATCH).otherwise(MISMATCH)
        return verdict(factor, out, theirs["confidence"], ours["confidence"], cite(theirs), F.array_join(ours["value"], ", "))

    return make


def held_all(factor: str, posting_field: str, profile_field: str, training: bool = False) -> Factor:
    """Everything required must be held; holding nothing is an answer, requiring nothing isn't.

    training: a shortfall is a mismatch with a caveat, and on an internship not comparable.
    """

    def make(p: Column, o: Column) -> Column:
        theirs, ours = o[posting_field], p[profile_field]
        held = F.size(F.array_except(_lower(theirs["value"]), _lower(ours["value"]))) == 0
        out = F.when(_empty(theirs) | ours.isNull() | ours["value"].isNull(), NOT_COMPARABLE).when(held, MATCH)
        if training:
            out = out.when(o["type"] == "internship", TRAINED)
        text = F.coalesce(F.nullif(F.array_join(ours["value"], ", "), F.lit("")), F.when(ours.isNotNull(), "none"))
        return verdict(factor, out.otherwise(MISMATCH), theirs["confidence"], ours["confidence"], cite(theirs, True), text, on_mismatch=TRAINING_UNKNOWN if training else None)

    return make


def hiring_country(p: Column, o: Column) -> Column:
    """Where a person can be employed against the posting's hiring office; "anywhere" always matches."""
    scope, ours = o["hiring_scope"], p["hiring_country"]
    unread = F.array(F.lit(OFFICE_UNKNOWN))
    shared = F.arrays_overlap(_lower(scope["countries"]), _lower(ours["value"]))
    blank = scope.isNull() | _empty(ours)
    out = F.when(blank, NOT_COMPARABLE).when(scope["anywhere"], MATCH).when(F.size(scope["countries"]) == 0, NOT_COMPARABLE).when(shared, MATCH).otherwise(MISMATCH)
    caveats = F.when(~blank & ~scope["anywhere"] & ((F.size(scope["countries"]) == 0) | (F.size(scope["unresolved"]) > 0)), unread)
    mark = F.concat(F.lit(" ["), scope["provenance"], F.lit("]"))
    text = F.when(scope["anywhere"], F.concat(F.lit("hires anywhere"), mark)).when(F.size(scope["countries"]) > 0, F.concat(F.array_join(scope["countries"], ", "), mark)).otherwise(F.array_join(scope["unresolved"], ", "))
    return verdict("hiring_country", out, scope["confidence"], ours["confidence"], text, F.array_join(ours["value"], ", "), caveats)


def experience(p: Column, o: Column) -> Column:
    """A career stage accepts its own levels and neighbouring ones; an undecided person is nothing to compare."""
    level, stage = o["experience_level"], p["career_stage"]
    accepted = F.create_map(*[x for s, ls in STAGE_LEVELS.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in ls]))])
    fits = F.array_contains(F.try_element_at(accepted, stage["value"]), level["value"])
    out = F.when(level.isNull() | stage.isNull() | ~F.coalesce(stage["value"].isin(*STAGE_LEVELS), F.lit(False)), NOT_COMPARABLE).when(fits, MATCH).otherwise(MISMATCH)
    return verdict("experience", out, level["confidence"], stage["confidence"], cite(level), stage["value"])


def career_goal(p: Column, o: Column) -> Column:
    """All filled parts of the goal that the posting has too must agree; the weakest confidence counts."""
    fact = p["career_goal"]
    parts = F.array(*[F.struct(F.lit(n).alias("name"), fact["value"][n].alias("wanted"), o[n]["value"].alias("actual"), o[n]["confidence"].alias("c")) for n in ("profession", "direction", "country")])
    compared = F.filter(parts, lambda x: x["wanted"].isNotNull() & x["actual"].isNotNull())
    agree = F.forall(compared, lambda x: F.lower(x["wanted"]) == F.lower(x["actual"]))
    out = F.when(fact.isNull() | (F.size(compared) == 0), NOT_COMPARABLE).when(agree, MATCH).otherwise(MISMATCH)
    goal = F.array_join(F.transform(F.filter(parts, lambda x: x["wanted"].isNotNull()), lambda x: F.concat(x["name"], F.lit("="), x["wanted"])), ", ")
    have = F.array_join(F.transform(compared, lambda x: F.concat(x["name"], F.lit("="), x["actual"])), ", ")
    return verdict("career_goal", out, F.array_min(F.transform(compared, lambda x: x["c"])), fact["confidence"], F.nullif(have, F.lit("")), F.when(fact.isNotNull(), goal))


FACTORS: tuple[Factor, ...] = (
    membership("profession", "profession", "professions"),
    membership("direction", "direction", "directions"),
    held_all("languages", "required_languages", "languages"),
    experience,
    held_all("certificates", "required_certificates", "certificates", training=True),
    membership("country", "country", "preferred_countries"),
    hiring_country,
    career_goal,
)


def score(pairs: DataFrame, profile: str = "profile", posting: str = "posting", factors: Sequence[Factor] = FACTORS) -> DataFrame:
    """pairs with verdicts, value and comparable_factors.

    pairs hold one struct per side. value is the matched share of the comparable weight, null if that is zero.
    Scoring is a projection: how pairs are formed (a candidate join, one profile, one posting) is the caller's
    choice, and the caller's can add factors of their own.
    """
    out = pairs.withColumn("_found", F.array(*[f(F.col(profile), F.col(posting)) for f in factors]))
    # Read twice, so that the findings stay a projection of their own and are made once.
    out = out.withColumn("verdicts", F.when(F.size("_found") > 0, F.transform("_found", _finish))).drop("_found")
    total = F.aggregate("verdicts", F.lit(0.0), lambda a, v: a + v["weight"])
    matched = F.aggregate("verdicts", F.lit(0.0), lambda a, v: a + F.when(v["outcome"] == MATCH, v["weight"]).otherwise(0.0))
    compared = F.size(F.filter("verdicts", lambda v: v["outcome"] != NOT_COMPARABLE))
    return out.withColumn("value", F.when(total > 0, matched / total)).withColumn("comparable_factors", compared)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in the given order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


