"""Evaluation of extracted requirements against hand-labelled records: both fields, the no-signal stratum, bases, disagreements, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions.text import percent, quote_in
from marlinspike.operators.completion import RESPONSE, named_by_quote

#: A labelled record.
GOLD = "source_id string, external_id string, stratum string, url string, title string, text string, level string, level_basis string, level_quote string, certificates array<struct<key:string,quote:string>>, notes string"
#: What a run answered for a record: the response as JSON.
PREDICTION = "source_id string, external_id string, run string, response string"
LEVEL, CERTIFICATES = "experience_level", "required_certificates"
METRICS = ("precision", "recall", "false_fill_rate", "invalid_quote_rate")
QUOTE_SHOWN = 70


def read_gold(spark: SparkSession, path: str, bound: int = 100_000) -> DataFrame:
    """Labelled records of a YAML file with a list under `records` (JSON is YAML too): a small hand-made set, bounded.

    Reading YAML needs the yaml package; a file that is JSON is read without it.
    """
    text = Path(path).read_text(encoding="utf-8")
    try:
        loaded = json.loads(text)
    except ValueError:
        import yaml

        loaded = yaml.safe_load(text)
    records = loaded["records"] if isinstance(loaded, dict) else None
    if not isinstance(records, list) or len(records) > bound:
        raise ValueError("no list of records, or more than a hand-labelled set can have")
    rows = []
    for r in records:
        quotes = r.get("certificate_quotes") or {}
        certs = [(k, quotes.get(k)) for k in r.get("required_certificates") or []]
        rows.append((r["source_id"], str(r["external_id"]), r.get("stratum"), r.get("url"), r.get("title"), r["text"], r.get("experience_level"), r.get("experience_basis"), r.get("experience_quote"), certs, r.get("notes")))
    return spark.createDataFrame(rows, GOLD)


def write_gold(sample: DataFrame, path: str, bound: int = 10_000) -> int:
    """Writes a template to be labelled, one record a line; records that the file holds already keep their labels as they are.

    sample: source_id, external_id, stratum, url, title, text. Running it again on the same sample changes
    nothing; the number of added records is returned.
    """
    file = Path(path)
    known = json.loads(file.read_text(encoding="utf-8"))["records"] if file.exists() else []
    have = {(r["source_id"], r["external_id"]) for r in known}
    rows = sample.select("source_id", "external_id", "stratum", "url", "title", "text").orderBy("source_id", "external_id").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} records to label")
    blank = {"experience_level": None, "experience_basis": None, "experience_quote": None, "required_certificates": [], "certificate_quotes": {}, "notes": ""}
    new = [r.asDict() | blank for r in rows if (r["source_id"], r["external_id"]) not in have]
    lines = ",\n".join(json.dumps(r, ensure_ascii=False) for r in [*known, *new])
    file.write_text(f'{{"records": [\n{lines}\n]}}\n', encoding="utf-8")
    return len(new)


def aligned(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every labelled record once per run with what the run accepted: columns level_*, items, rejected.

    A run without an answer for a record stays unfilled. Certificates whose quote doesn't name them are
    rejected, as in completion. The runs' names are few and are checked before they are broadcast.
    """
    names = [r[0] for r in predictions.select("run").distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 runs")
    every = gold.withColumn("run", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    rows = every.join(predictions.select("source_id", "external_id", "run", F.from_json("response", RESPONSE).alias("r")), ["source_id", "external_id", "run"], "left")
    items = F.coalesce("r.required_certificates", F.array().cast("array<struct<key:string,quote:string,basis:string>>"))
    named = lambda c: c["key"].isNull() | c["quote"].isNull() | named_by_quote(c["key"], c["quote"])
    return rows.select(
        "source_id", "external_id", "run", "stratum", "text", F.col("level").alias("gold_level"), F.array_sort(F.array_distinct(F.transform(F.coalesce("certificates", F.array().cast("array<struct<key:string,quote:string>>")), lambda c: c["key"]))).alias("gold_keys"),
        F.col("r.experience_level").alias("said"), F.filter(items, named).alias("items"), F.filter(items, lambda c: ~named(c)).alias("rejected"),
    )


def metrics(rows: DataFrame) -> DataFrame:
    """(run, field, rows, precision, recall, false_fill_rate, invalid_quote_rate, stated, inferred) of aligned() rows.

    Fields are the level and the certificates, over all records and over those of a no-signal stratum. Lists
    are compared as sets; each certificate's quote counts by itself. Empty denominators are null.
    """
    keys = F.array_sort(F.array_distinct(F.filter(F.transform("items", lambda c: c["key"]), lambda k: k.isNotNull())))
    value, no_signal = F.col("said.value"), F.endswith(F.col("stratum"), F.lit("no-signal"))
    quoted_badly = F.size(F.filter("items", lambda c: ~quote_in(F.col("text"), c["quote"])))
    based = lambda b: F.size(F.filter("items", lambda c: c["basis"] == b))
    level = F.struct(
        F.lit(LEVEL).alias("field"), value.isNotNull().alias("filled"), F.col("gold_level").isNotNull().alias("gold"), value.eqNullSafe(F.col("gold_level")).alias("equal"), value.isNotNull().cast("int").alias("quotes"),
        (value.isNotNull() & ~quote_in(F.col("text"), F.col("said.quote"))).cast("int").alias("bad"), (value.isNotNull() & F.col("said.basis").eqNullSafe("stated")).cast("int").alias("stated"), (value.isNotNull() & F.col("said.basis").eqNullSafe("inferred")).cast("int").alias("inferred"),
    )
    certs = F.struct(F.lit(CERTIFICATES).alias("field"), (F.size(keys) > 0).alias("filled"), (F.size("gold_keys") > 0).alias("gold"), (keys == F.col("gold_keys")).alias("equal"), F.size("items").alias("quotes"), quoted_badly.alias("bad"), based("stated").alias("stated"), based("inferred").alias("inferred"))
    # Cast to one type: names inside a struct of lambdas get lost.
    kind = "struct<field:string,filled:boolean,gold:boolean,equal:boolean,quotes:int,bad:int,stated:int,inferred:int>"
    parts = F.explode(F.array_compact(F.array(F.lit(""), F.when(no_signal, "no-signal / "))))
    each = rows.select("run", parts.alias("part"), F.array(level.cast(kind), certs.cast(kind)).alias("fs")).select("run", "part", F.explode("fs").alias("f")).select("run", F.concat("part", "f.field").alias("field"), "f.filled", "f.gold", "f.equal", "f.quotes", "f.bad", "f.stated", "f.inferred")
    correct = F.count_if(F.col("filled") & F.col("equal"))
    return each.groupBy("run", "field").agg(
        F.count("*").alias("rows"),
        F.try_divide(correct, F.count_if("filled")).alias("precision"),
        F.try_divide(correct, F.count_if("gold")).alias("recall"),
        F.try_divide(F.count_if(F.col("filled") & ~F.col("gold")), F.count("*")).alias("false_fill_rate"),
        F.try_divide(F.sum("bad"), F.sum("quotes")).alias("invalid_quote_rate"),
        F.sum("stated").alias("stated"),
        F.sum("inferred").alias("inferred"),
    )


def disagreements(rows: DataFrame) -> DataFrame:
    """(run, field, kind, external_id, gold, predicted, quote) of aligned() rows, ordered by run, field, kind and id.

    Kinds: false_fill, wrong_value, invalid_quote and, for certificates, key_rejected. Quotes of surplus
    certificates are shown up to 70 characters.
    """
    keys = F.array_sort(F.array_distinct(F.filter(F.transform("items", lambda c: c["key"]), lambda k: k.isNotNull())))
    value, text = F.col("said.value"), F.col("text")
    gold, mine = F.array_join("gold_keys", ", "), F.array_join(keys, ", ")
    added = F.array_except(keys, F.col("gold_keys"))
    first_quote = lambda k: F.coalesce(F.get(F.filter("items", lambda c: (c["key"] == k) & c["quote"].isNotNull()), F.lit(0))["quote"], F.lit("?"))
    surplus = F.nullif(F.array_join(F.transform(added, lambda k: F.concat(k, F.lit(" <- "), F.left(first_quote(k), F.lit(QUOTE_SHOWN)))), "; "), F.lit(""))

    def found(field: str, kind: str, g: Column, p: Column, q: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), g.cast("string").alias("gold"), p.cast("string").alias("predicted"), q.cast("string").alias("quote")).cast("struct<field:string,kind:string,gold:string,predicted:string,quote:string>")

    none = F.lit(None).cast("string")
    singles = F.array_compact(
        F.array(
            F.when(value.isNotNull() & F.col("gold_level").isNull(), found("experience", "false_fill", none, value, F.col("said.quote"))),
            F.when(value.isNotNull() & (value != F.col("gold_level")), found("experience", "wrong_value", F.col("gold_level"), value, F.col("said.quote"))),
            F.when(value.isNotNull() & ~quote_in(text, F.col("said.quote")), found("experience", "invalid_quote", F.col("gold_level"), value, F.col("said.quote"))),
            F.when((F.size(keys) > 0) & (F.size("gold_keys") == 0), found("certificates", "false_fill", gold, mine, surplus)),
            F.when((F.size(keys) > 0) & (F.size("gold_keys") > 0) & (keys != F.col("gold_keys")), found("certificates", "wrong_value", gold, mine, surplus)),
        )
    )
    rejected = F.transform("rejected", lambda c: found("certificates", "key_rejected", none, c["key"], c["quote"]))
    unquoted = F.transform(F.filter("items", lambda c: c["key"].isNotNull() & ~quote_in(text, c["quote"])), lambda c: found("certificates", "invalid_quote", none, c["key"], c["quote"]))
    return rows.select("run", "external_id", F.explode(F.concat(singles, rejected, unquoted)).alias("d")).select("run", "d.field", "d.kind", "external_id", "d.gold", "d.predicted", "d.quote").orderBy("run", "field", "kind", "external_id")


def tally(found: DataFrame) -> DataFrame:
    """(field, kind, n) of disagreements."""
    return found.groupBy("field", "kind").agg(F.count("*").alias("n"))


def metric_lines(measured: DataFrame) -> DataFrame:
    """(run, field, line): each run's metrics as text, in order."""
    cells = [F.concat(F.lit(m.replace("_", " ") + " "), percent(F.col(m))) for m in METRICS]
    bases = F.format_string("stated %d, inferred %d", "stated", "inferred")
    return measured.select("run", "field", F.concat(F.col("field"), F.lit(": "), F.concat_ws("; ", *cells, bases)).alias("line")).orderBy("run", "field")


def spread_lines(spread: DataFrame) -> DataFrame:
    """(field, line): mean and range of each metric over runs as text; without a range where all runs agree."""
    cell = F.concat(F.regexp_replace("metric", "_", " "), F.lit(" "), percent(F.col("mean")), F.when(F.col("least") != F.col("most"), F.concat(F.lit(" ("), percent(F.col("least")), F.lit(" to "), percent(F.col("most")), F.lit(")"))).otherwise(""))
    return spread.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list(cell)), "; ").alias("cells")).select("field", F.concat(F.col("field"), F.lit(": "), F.col("cells")).alias("line")).orderBy("field")


def disagreement_lines(found: DataFrame) -> DataFrame:
    """(line): the tally of disagreements as text, ordered by field and kind."""
    return tally(found).orderBy("field", "kind").select(F.format_string("%s/%s: %d", "field", "kind", "n").alias("line"))
