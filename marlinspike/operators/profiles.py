"""Facts about people with precedence, the behaviour journal and interest counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.functions.text import literal_map
from marlinspike.operators.tables import ParquetTable
from marlinspike.vocab import CAREER_STAGES, CERTIFICATES, DIRECTIONS, LANGUAGES, PROFESSIONS

#: Ways a fact is known; fixed values.
STATED = "stated"


#: Facts about a person, the vocabulary each is checked against ("code" is the shape of a country code), and the parts of a goal; fixed values.
FACTS = {"career_stage": None, "career_goal": None, "professions": "professions", "directions": "directions", "certificates": "certificates", "languages": "languages", "residence_country": "code", "citizenship": "code", "work_authorization": "code", "preferred_countries": "code", "hiring_country": "code"}
GOAL_PARTS = {"profession": "professions", "direction": "directions", "country": "code"}
VOCABULARIES = {"professions": list(PROFESSIONS), "directions": DIRECTIONS, "certificates": list(CERTIFICATES), "languages": list(LANGUAGES)}
SOURCES = (STATED, "imported", "observed")
#: A change to a fact: `items` are its values, a single value being one item; a goal's are "part=key". Null items clear it.
CHANGE = "user_id string, field string, source string, confidence double, at timestamp, seq long, items array<string>"


def current_facts(log: DataFrame, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The fact each person holds per field after folding the change log: (user_id, field, value, source, stated_at).

    log: user_id, field, source, at, seq, value (null clears the field). Changes apply in order of (at, seq);
    one that isn't stated never replaces or clears a stated one. A stated change always applies, so what holds
    is the last stated change if it set a value, and otherwise the newest change of all. Both are maxima of one
    aggregation, combined before the shuffle, so a person with a third of all changes costs no more than others.
    Fields that end cleared give no row; null users or fields drop out.
    """
    by = F.struct(*order)
    change = F.struct("value", "source", F.col("at").alias("stated_at"))
    stated = F.col("source") == STATED
    last = log.where("user_id is not null and field is not null").groupBy("user_id", "field").agg(F.max_by(change, by).alias("newest"), F.max_by(change, F.when(stated, by)).alias("stated"))
    holds = F.when(F.col("stated.value").isNotNull(), F.col("stated")).otherwise(F.col("newest"))
    return last.select("user_id", "field", holds.alias("h")).where("h.value is not null").select("user_id", "field", "h.*")


def canonical_items(field: Column, items: Column) -> Column:
    """Country codes in upper case, other items as they are."""
    codes = [f for f, v in FACTS.items() if v == "code"]
    return F.transform(items, lambda x: F.when(field.isin(*codes) | ((field == "career_goal") & F.startswith(x, F.lit("country="))), F.concat(F.when(field == "career_goal", "country=").otherwise(""), F.upper(F.when(field == "career_goal", F.substring(x, 9, 1000)).otherwise(x)))).otherwise(x))


def _known(vocabulary: Column, value: Column) -> Column:
    """Whether a value is a key of the named vocabulary, or has the shape of a country code."""
    out = F.when(vocabulary == "code", value.rlike("^[A-Z]{2}$"))
    for name, keys in VOCABULARIES.items():
        out = out.when(vocabulary == name, value.isin(*keys))
    return F.coalesce(out.otherwise(False), F.lit(False))


def checked_changes(changes: DataFrame) -> DataFrame:
    """Changes (see CHANGE) with canonical items and `errors`, an empty array where a change may be applied.

    unknown_field, unknown_source, confidence_out_of_range, stated_not_certain, empty_goal, unknown_part and
    unknown_key. Clearing (null items) only needs a known field and source.
    """
    field, none = F.col("field"), F.array().cast("array<string>")
    vocabulary = F.try_element_at(literal_map({k: v or "" for k, v in FACTS.items()}), field)
    rows = changes.withColumn("items", canonical_items(field, F.col("items")))
    parts = F.transform("items", lambda x: F.substring_index(x, "=", 1))
    part_unknown = F.exists(parts, lambda p: ~p.isin(*GOAL_PARTS))
    part_key = lambda x: _known(F.try_element_at(literal_map(GOAL_PARTS), F.substring_index(x, "=", 1)), F.regexp_replace(x, "^[^=]*=", ""))
    goal = field == "career_goal"
    key_unknown = F.when(goal, ~part_unknown & F.exists("items", lambda x: ~part_key(x))).when(field == "career_stage", F.exists("items", lambda x: ~x.isin(*CAREER_STAGES))).otherwise(F.exists("items", lambda x: ~_known(vocabulary, x)))
    sure = F.coalesce(F.col("confidence"), F.lit(-1.0))
    given = F.col("items").isNotNull()
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(field.isin(*FACTS), F.lit(False)), "unknown_field"),
            F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "unknown_source"),
            F.when(given & ~sure.between(0.0, 1.0), "confidence_out_of_range").when(given & (F.col("source") == STATED) & (sure != 1.0), "stated_not_certain"),
            F.when(goal & given & (F.size("items") == 0), "empty_goal").when(goal & given & part_unknown, "unknown_part"),
            F.when(given & field.isin(*FACTS) & key_unknown, "unknown_key"),
        )
    )
    return rows.withColumn("errors", F.coalesce(errors, none))


def set_facts(profiles: DataFrame, facts: DataFrame, changes: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, facts, refused) after applying changes in order of (at, seq).

    profiles: user_id, created_at, updated_at; facts: user_id, field, value (a struct of items and confidence),
    source, stated_at. Refused are changes with errors, those of people without a profile (no_profile) and, of
    changes that aren't stated, those on a fact that is stated when they come (stated_is_protected; told by what
    holds before and after all changes). A person's updated_at moves only if a fact of theirs became another
    one: a refused change, and clearing what isn't there, touch nothing.
    """
    now = now if now is not None else F.current_timestamp()
    checked = checked_changes(changes).join(profiles.select("user_id", F.lit(True).alias("_here")), "user_id", "left")
    checked = checked.withColumn("errors", F.when(F.col("_here").isNull(), F.concat("errors", F.array(F.lit("no_profile")))).otherwise(F.col("errors"))).drop("_here")
    value = F.when(F.col("items").isNotNull(), F.struct("items", "confidence"))
    log = facts.select("user_id", "field", "value", "source", F.col("stated_at").alias("at"), F.lit(0).alias("era"), F.lit(0).cast("long").alias("seq"))
    log = log.unionByName(checked.where(F.size("errors") == 0).select("user_id", "field", value.alias("value"), "source", "at", F.lit(1).alias("era"), "seq"))
    after = current_facts(log, ("era", "at", "seq"))
    old, new = facts.alias("o"), after.alias("n")
    same = (F.col("o.user_id") == F.col("n.user_id")) & (F.col("o.field") == F.col("n.field"))
    moved = old.join(new, same, "full").where(~(F.struct("o.value", "o.source", "o.stated_at").eqNullSafe(F.struct("n.value", "n.source", "n.stated_at")))).select(F.coalesce("o.user_id", "n.user_id").alias("user_id")).distinct().withColumn("_moved", F.lit(True))
    touched = profiles.join(moved, "user_id", "left").withColumn("updated_at", F.when(F.col("_moved"), now).otherwise(F.col("updated_at"))).drop("_moved")
    stood = facts.where(F.col("source") == STATED).select("user_id", "field").join(after.where(F.col("source") == STATED).select("user_id", "field"), ["user_id", "field"], "left_semi").withColumn("_stood", F.lit(True))
    judged = checked.join(stood, ["user_id", "field"], "left")
    protected = F.col("_stood") & (F.col("source") != STATED)
    refused = judged.withColumn("errors", F.when(protected, F.concat("errors", F.array(F.lit("stated_is_protected")))).otherwise(F.col("errors"))).drop("_stood").where(F.size("errors") > 0)
    return touched, after, refused


def checked_events(events: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) events of a journal append: people must have a profile and a dwell time can't be negative. Equal events stay apart."""
    known = events.join(profiles.select("user_id").distinct().withColumn("_here", F.lit(True)), "user_id", "left")
    ok = F.col("_here").isNotNull() & (F.coalesce("dwell_seconds", F.lit(0)) >= 0)
    return known.where(ok).drop("_here"), known.where(~ok).select(*events.columns, F.when(F.col("_here").isNull(), "no_profile").otherwise("negative_dwell").alias("error"))


def append_events(journal: ParquetTable, events: DataFrame, profiles: DataFrame) -> int:
    """Appends events, all or none: a refused one is an error. There is no way to change or remove one event."""
    accepted, refused = checked_events(events, profiles)
    if not refused.isEmpty():
        raise ValueError(f"events refused: {refused.groupBy('error').count().collect()}")
    journal.append(accepted.select(*events.columns))
    return accepted.count()


def profile_of(profiles: DataFrame, user_id: str) -> DataFrame:
    """One person's profile by key; no row if there is none."""
    return profiles.where(F.col("user_id") == user_id)


def unknown_keys(values: Column, vocabulary: list[str]) -> Column:
    """The values that a vocabulary doesn't hold; null for null."""
    return F.array_except(values, F.array(*[F.lit(v) for v in vocabulary]))


def interest_counts(journal: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(user_id, dimension, key, action, n): actions in total, by direction and by profession of what they were on.

    Events on postings that are gone count under a null key. journal: user_id, opportunity_id, action;
    opportunities: id, direction, profession (one row per id).
    """
    joined = journal.join(opportunities.select(F.col("id").alias("opportunity_id"), "direction", "profession"), "opportunity_id", "left")
    return (
        joined.groupingSets([["user_id", "action"], ["user_id", "action", "direction"], ["user_id", "action", "profession"]], "user_id", "action", "direction", "profession")
        .agg(F.count("*").alias("n"), F.grouping("direction").alias("g1"), F.grouping("profession").alias("g2"))
        .select(
            "user_id",
            F.when((F.col("g1") == 1) & (F.col("g2") == 1), "total").when(F.col("g2") == 1, "direction").otherwise("profession").alias("dimension"),
            F.when(F.col("g1") == 0, F.col("direction")).when(F.col("g2") == 0, F.col("profession")).alias("key"),
            "action",
            "n",
        )
    )


def export(profiles: DataFrame, journal: DataFrame) -> DataFrame:
    """Each profile with its events as rows in order of (user_id, occurred_at, id), one with null event columns without any.

    Rows are range-partitioned by person and time and sorted there, so a person's journal may span partitions
    and files and is never gathered; export_of() gives one named person's list.
    """
    events = journal.select("user_id", F.col("id").alias("event_id"), "occurred_at", "opportunity_id", "action")
    return profiles.join(events, "user_id", "left").repartitionByRange("user_id", "occurred_at", "event_id").sortWithinPartitions("user_id", "occurred_at", "event_id")


def export_of(profiles: DataFrame, journal: DataFrame, user_id: str) -> DataFrame:
    """One named person's profile with the list of their events in order, empty without any: what that person asked for."""
    own = journal.where(F.col("user_id") == user_id).select(F.struct("occurred_at", "id", "opportunity_id", "action").alias("e"))
    events = own.agg(F.array_sort(F.collect_list("e")).alias("events"))
    return profiles.where(F.col("user_id") == user_id).limit(1).join(events)


def without_people(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A table without the rows of deleted people."""
    return table.join(gone.select("user_id").distinct(), "user_id", "left_anti")
