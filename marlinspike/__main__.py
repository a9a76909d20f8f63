"""Commands over a folder of tables: python -m marlinspike COMMAND --folder FOLDER ...; see --help."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlinspike import jobs
from marlinspike.operators import evaluation, profiles, reports
from marlinspike.operators.model_client import PROMPT_VERSION
from marlinspike.operators.tables import ParquetTable
from marlinspike.session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlinspike", description=__doc__)
    top.add_argument("--folder", default="tables", help="where the tables are")
    top.add_argument("--registry", help="Parquet table of sources")
    parts = top.add_subparsers(dest="command", required=True)
    for name, what in (("refetch", "store a feed's new raw versions"), ("run", "refetch, then reprocess the source")):
        p = parts.add_parser(name, help=what)
        p.add_argument("--source", required=True)
        p.add_argument("--path", required=True, help="the feed's files")
        if name == "run":
            p.add_argument("--limit", type=int)
    p = parts.add_parser("reprocess", help="run the stages again over stored raw versions")
    p.add_argument("--source")
    p = parts.add_parser("coverage", help="fill rates of a source")
    p.add_argument("--source", required=True)
    p = parts.add_parser("evaluate", help="ask a client about labelled records and measure its answers")
    p.add_argument("--gold", required=True)
    p.add_argument("--client", required=True, help="module:function that makes a client")
    p.add_argument("--model", default="model")
    p.add_argument("--runs", type=int, default=1)
    p.add_argument("--show-errors", action="store_true")
    p.add_argument("--no-log", action="store_true")
    p = parts.add_parser("export", help="a person's profile and events as JSON")
    p.add_argument("--user", required=True)
    parts.add_parser("upgrade", help="bring the tables to the newest version")
    return top


def _lines(rows: DataFrame, say: Callable[[str], None], most: int = 10_000) -> None:
    """Prints a report's lines; reports have a line per source, field or kind."""
    for r in rows.limit(most).collect():
        say(r.line)


def main(args: list[str], spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    a = parser().parse_args(args)
    spark = spark or local_session()
    registry = spark.read.parquet(a.registry) if a.registry else None
    try:
        if a.command in ("refetch", "run", "reprocess") and registry is None:
            raise LookupError(f"{a.command} needs --registry")
        if a.command == "refetch":
            say(f"new raw versions: {jobs.refetch(spark, a.folder, registry, a.source, a.path)}")
        elif a.command == "run":
            fetched, done = jobs.ingest(spark, a.folder, registry, a.source, a.path, a.limit)
            say(f"new raw versions: {fetched}; postings: {done}")
        elif a.command == "reprocess":
            say(f"postings: {jobs.reprocess(spark, a.folder, registry, a.source)}")
        elif a.command == "coverage":
            _lines(reports.report_lines(jobs.coverage(spark, a.folder, a.source)), say)
        elif a.command == "upgrade":
            say(f"versions applied: {', '.join(jobs.upgrade(spark, a.folder)) or 'none'}")
        elif a.command == "export":
            people, journal = (ParquetTable(spark, f"{a.folder}/{name}").read() for name in ("profiles", "journal"))
            found = None if people is None or journal is None else profiles.export_of(people, journal, a.user).first()
            if found is None:
                raise LookupError(f"no profile of {a.user}")
            say(json.dumps(found.asDict(recursive=True), default=str))
        else:
            module, _, name = a.client.partition(":")
            make = getattr(importlib.import_module(module), name)
            gold = evaluation.read_gold(spark, a.gold)
            answers = jobs.predict(spark, gold, f"{a.folder}/predictions", make, a.runs, PROMPT_VERSION, a.model)
            log = None if a.no_log else ParquetTable(spark, f"{a.folder}/measurements")
            measured, spread, found = jobs.evaluate(gold, answers, log, PROMPT_VERSION, a.model)
            _lines(evaluation.metric_lines(measured), say)
            if a.runs > 1:
                _lines(evaluation.spread_lines(spread), say)
            if a.show_errors:
                _lines(evaluation.disagreement_lines(found), say)
    except (LookupError, ValueError) as e:
        print(f"marlinspike: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
