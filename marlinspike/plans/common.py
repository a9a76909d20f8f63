"""What several query modules share: tables with each row once, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlinspike.session import table

#: What the rules read of a posting that has no text or title.
TEXT, TITLE = "coalesce(description, '')", "coalesce(title, '')"


def once(spark: SparkSession, d: str, name: str, key: str = "id") -> DataFrame:
    """A table with each delivered row once."""
    return table(spark, d, name).dropDuplicates([key])


#: The same in SQL.
def once_sql(name: str, key: str = "id") -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {key}) = 1)"


POSTINGS = once_sql("normalized_opportunities")
RAW = once_sql("raw_items")
STORED = once_sql("opportunities")
EVENTS = once_sql("behaviour_events")
WB = r"(^|[^\p{L}\p{N}_])"
WE = r"([^\p{L}\p{N}_]|$)"


def sql_quote(text: str) -> str:
    return text.replace("'", "''")


def sql_regex(term: str) -> str:
    """A term as a regular expression inside an SQL text."""
    return sql_quote("".join("\\" + ch if ch in r"\.^$|?*+()[]{}/-" else ch for ch in term))
