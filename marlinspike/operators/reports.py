"""Fill-rate, extraction-quality and data-loss reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlinspike.functions.text import percent, quote_in, strip_markup
from marlinspike.operators.enrich import certificate_keys
from marlinspike.vocab import CERTIFICATES, EXPERIENCE_LEVELS


def filled(value: Column, kind: str) -> Column:
    """Whether a value counts as filled: not null, and a text or list not empty."""
    if kind.startswith("array"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    return value.isNotNull()


def coverage(postings: DataFrame, plain: Sequence[str], derived: Sequence[str] = (), by: Sequence[str] = ("source_id", "source_trust")) -> DataFrame:
    """One row per source and trust: total, active, rejected, and filled_<field> over the active rows.

    derived fields are structs with value. One pass with conditional sums, whatever the number of fields.
    """
    kinds = dict(postings.dtypes)
    active = F.col("status") == "active"
    checks = [F.count_if(active & filled(F.col(f), kinds[f])).alias(f"filled_{f}") for f in plain]
    for f in derived:
        value = postings.schema[f].dataType["value"].dataType.simpleString()
        checks.append(F.count_if(active & F.col(f).isNotNull() & filled(F.col(f)["value"], value)).alias(f"filled_{f}"))
    return postings.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "rejected").alias("rejected"), *checks)


def provenance_histogram(postings: DataFrame, fields: Sequence[str], by: Sequence[str] = ("source_id",)) -> DataFrame:
    """(by..., field, provenance, n) over active rows with a value."""
    parts = []
    for f in fields:
        value = postings.schema[f].dataType["value"].dataType.simpleString()
        parts.append(F.when(F.col(f).isNotNull() & filled(F.col(f)["value"], value), F.struct(F.lit(f).alias("field"), F.col(f)["provenance"].alias("provenance"))))
    rows = postings.where("status = 'active'").select(*by, F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return rows.groupBy(*by, "x.field", "x.provenance").agg(F.count("*").alias("n"))


def rejection_reasons(postings: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """(by..., flag, n) over rejected rows."""
    return postings.where("status = 'rejected'").select(*by, F.explode("quality_flags").alias("flag")).groupBy(*by, "flag").agg(F.count("*").alias("n"))


def extraction_metrics(rows: DataFrame, gold: Column, predicted: Column, quote: Column, text: Column, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, false_fill_rate and invalid_quote_rate of single-valued predictions; empty denominators are null."""
    gold_filled, pred_filled = gold.isNotNull(), predicted.isNotNull()
    correct, n = F.count_if(pred_filled & gold.eqNullSafe(predicted)), F.count("*")
    return rows.groupBy(*by).agg(
        n.alias("rows"),
        F.try_divide(correct, F.count_if(pred_filled)).alias("precision"),
        F.try_divide(correct, F.count_if(gold_filled)).alias("recall"),
        F.try_divide(F.count_if(pred_filled & ~gold_filled), n).alias("false_fill_rate"),
        F.try_divide(F.count_if(pred_filled & ~quote_in(text, quote)), F.count_if(pred_filled)).alias("invalid_quote_rate"),
    )


def list_metrics(rows: DataFrame, gold: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall and false_fill_rate of list predictions, lists compared as sets."""
    g, p = F.array_sort(F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))), F.array_sort(F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>"))))
    correct, n = F.count_if((F.size(p) > 0) & (g == p)), F.count("*")
    return rows.groupBy(*by).agg(
        n.alias("rows"),
        F.try_divide(correct, F.count_if(F.size(p) > 0)).alias("precision"),
        F.try_divide(correct, F.count_if(F.size(g) > 0)).alias("recall"),
        F.try_divide(F.count_if((F.size(p) > 0) & (F.size(g) == 0)), n).alias("false_fill_rate"),
    )


def spread(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("field",)) -> DataFrame:
    """(by..., metric, mean, least, most) over runs; nulls don't count, all-null stays null."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    return runs.select(*by, F.explode(pairs).alias("x")).groupBy(*by, "x.metric").agg(F.avg("x.v").alias("mean"), F.min("x.v").alias("least"), F.max("x.v").alias("most"))


def disagreements(rows: DataFrame, key: str, gold: Column, predicted: Column, quote: Column, text: Column, field: str) -> DataFrame:
    """(key, field, kind, gold, predicted): false_fill, wrong_value and invalid_quote, one row each."""
    kinds = F.array_compact(
        F.array(
            F.when(predicted.isNotNull() & gold.isNull(), "false_fill").when(predicted.isNotNull() & (gold != predicted), "wrong_value"),
            F.when(predicted.isNotNull() & ~quote_in(text, quote), "invalid_quote"),
        )
    )
    return rows.select(key, F.lit(field).alias("field"), gold.alias("gold"), predicted.alias("predicted"), F.explode(kinds).alias("kind"))


def gold_violations(gold: DataFrame) -> DataFrame:
    """(external_id, rule) for every broken rule of a labelled record.

    gold: external_id, text, level, level_basis, level_quote, certificates (array of struct key, quote).
    """
    certs = F.coalesce("certificates", F.array().cast(gold.schema["certificates"].dataType))
    known = [k for k in CERTIFICATES]
    rules = F.array_compact(
        F.array(
            F.when(F.col("level").isNotNull() & ~F.col("level").isin(*EXPERIENCE_LEVELS), "level_unknown"),
            F.when(F.col("level").isNotNull() & ~F.coalesce(F.col("level_basis").isin("stated", "inferred"), F.lit(False)), "basis_unknown"),
            F.when(F.col("level").isNull() & F.col("level_quote").isNotNull(), "quote_without_level"),
            F.when(F.col("level").isNotNull() & F.col("level_quote").isNull(), "level_without_quote"),
            F.when(F.col("level_quote").isNotNull() & ~quote_in(F.col("text"), F.col("level_quote")), "quote_not_in_text"),
            F.when(F.exists(certs, lambda c: ~c["key"].isin(*known)), "certificate_unknown"),
            F.when(F.exists(certs, lambda c: c["quote"].isNull()), "certificate_without_quote"),
            F.when(F.exists(certs, lambda c: c["quote"].isNotNull() & ~quote_in(F.col("text"), c["quote"])), "certificate_quote_not_in_text"),
        )
    )
    return gold.select("external_id", F.explode(rules).alias("rule"))


def gold_profile(gold: DataFrame) -> DataFrame:
    """(source_id, level, records, with_certificates, no_signal_filled): what a labelled set consists of, null levels too.

    gold: source_id, level, certificates, stratum.
    """
    held = F.coalesce(F.size("certificates") > 0, F.lit(False))
    return gold.groupBy("source_id", "level").agg(
        F.count("*").alias("records"), F.count_if(held).alias("with_certificates"), F.count_if((F.col("stratum") == "no-signal") & (F.col("level").isNotNull() | held)).alias("no_signal_filled")
    )


def run_log(metrics: DataFrame, run_id: str, prompt_version: str, model_id: str) -> DataFrame:
    """Metrics as rows of the append-only measurement log."""
    return metrics.select(F.lit(run_id).alias("run_id"), F.lit(prompt_version).alias("prompt_version"), F.lit(model_id).alias("model_id"), F.current_timestamp().alias("measured_at"), "*")


def lost_keys(records: DataFrame, present: Column, readable: Column, expected: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, n, expected): keys that a payload holds and the readable record doesn't; unexpected ones first, then by count."""
    gone = records.select(*by, F.explode(F.array_except(present, readable)).alias("key"))
    counted = gone.groupBy(*by, "key").agg(F.count("*").alias("n")).withColumn("expected", F.col("key").isin(*expected) if expected else F.lit(False))
    return counted.orderBy("expected", F.desc("n"), *by, "key")


def lost_certificates(records: DataFrame, payload: Column, readable: Column, expected: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """lost_keys() of the certificates named anywhere in a payload, markup aside, against those named in the readable text."""
    none = F.array().cast("array<string>")
    named = records.select(*by, F.coalesce(certificate_keys(strip_markup(payload)), none).alias("present"), F.coalesce(certificate_keys(readable), none).alias("readable"))
    return lost_keys(named, F.col("present"), F.col("readable"), expected, by)


def sampling_pool(postings: DataFrame, text: str = "text") -> DataFrame:
    """Postings worth labelling: a rule left the level or the certificates null and the text has at least 20 characters."""
    return postings.where((F.col("experience_level").isNull() | F.col("required_certificates").isNull()) & (F.length(F.trim(text)) >= 20))


def quotas(sizes: dict[str, int], total: int, favoured: str | None = None, favoured_most: int = 0) -> dict[str, int]:
    """An even split of `total` over strata, at most each one's size; what small ones lack goes to the largest remainders."""
    given = dict.fromkeys(sizes, 0)
    if favoured in sizes:
        given[favoured] = min(sizes[favoured], favoured_most, total)
    left = total - sum(given.values())
    while left > 0:
        room = [s for s in sorted(sizes, key=lambda s: (given[s] - sizes[s], s)) if given[s] < sizes[s]]
        if not room:
            break
        for s in room[:left]:
            given[s] += 1
        left = total - sum(given.values())
    return given


def stratified_sample(records: DataFrame, stratum: str, id_column: str, limits: dict[str, int], seed: int) -> DataFrame:
    """The first `limits` records of each stratum in the order of a seeded hash: the same sample in any run."""
    order = F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(stratum).orderBy(order, id_column)
    most = F.create_map(*[F.lit(x) for p in limits.items() for x in p]) if limits else F.create_map().cast("map<string,int>")
    return records.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.coalesce(F.try_element_at(most, F.col(stratum)), F.lit(0))).drop("_n")


def report_lines(report: DataFrame) -> DataFrame:
    """A coverage report as lines of text, ordered by trust and source."""
    shares = [f for f in report.columns if f.startswith("filled_")]
    cells = [F.concat(F.lit(f.removeprefix("filled_") + " "), percent(F.try_divide(F.col(f), F.col("active")))) for f in shares]
    line = F.concat_ws("; ", F.format_string("%s (%s): %d rows, %d active, %d rejected", "source_id", "source_trust", "total", "active", "rejected"), *cells)
    return report.select("source_trust", "source_id", line.alias("line")).orderBy("source_trust", "source_id")
