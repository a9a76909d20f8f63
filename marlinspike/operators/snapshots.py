"""What changed between full snapshots: signed cells whose nonzero sums classify records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comparisons(log: DataFrame, scope: Sequence[str] = ("source_id",), number: str = "snapshot_no") -> DataFrame:
    """Every complete delivery with the delivery it is compared as: (scope, number, after, before).

    after: the number of the comparison in which it is the later one (null for a scope's first), before: that in
    which it is the earlier one (null for the last). Deliveries logged twice count once, as complete if any log
    row says so.
    """
    done = log.where("is_complete").select(*scope, number).dropDuplicates()
    w = Window.partitionBy(*scope).orderBy(number)
    return done.select(*scope, number, F.when(F.lag(number).over(w).isNotNull(), F.col(number)).alias("after"), F.lead(number).over(w).alias("before"))


def _cell(value: Column) -> Column:
    """A field's value as a 62-bit fingerprint; null has one of its own, so it equals null and nothing else."""
    return F.shiftrightunsigned(F.xxhash64(F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))), 2)


def changes(
    snapshots: DataFrame,
    log: DataFrame,
    fields: dict[str, Column],
    scope: Sequence[str] = ("source_id",),
    key: Sequence[str] = ("external_id",),
    number: str = "snapshot_no",
    newest: str = "loaded_at",
) -> DataFrame:
    """Records added, removed or changed between consecutive complete snapshots of a scope.

    Columns: number (of the later snapshot), scope, key, change_kind, changed_fields (sorted array, null unless
    changed). Each record version is unpivoted into key-field-value cells with sign +1 in the comparison where
    its snapshot is the later one and -1 where it is the earlier, plus a presence marker; cells are summed per
    key: presence +1 is added, -1 removed, 0 with any nonzero field sum changed. The cells of one version travel
    as one row of signed fingerprints, so a field sum is zero exactly if both values are equal (up to a 62-bit
    hash). Of several rows for one record in a snapshot the one with the latest `newest` holds (ties: the
    greatest values); repeated rows change nothing. One shuffle, by scope and key, serves both groupings; no
    group is larger than one record's versions. Null keys form a key of their own; a null scope is in no log and
    drops out; empty tables give no rows; other columns are ignored.
    """
    by = [*scope, *key]
    pairs = comparisons(log, scope, number)
    latest = (
        snapshots.select(*by, number, newest, *[expr.alias(f"f_{name}") for name, expr in fields.items()])
        .join(pairs, [*scope, number])
        .repartition(*by)
        .groupBy(*by, number, "after", "before")
        .agg(F.max(F.struct(F.coalesce(F.col(newest), F.lit("0001-01-01").cast("timestamp")).alias("at"), *[F.col(f"f_{name}") for name in fields])).alias("row"))
    )
    signed = latest.select(
        *by,
        F.explode(F.array(F.struct(F.col("after").alias("cmp"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("cmp"), F.lit(-1).alias("sign")))).alias("s"),
        *[_cell(F.col(f"row.f_{name}")).alias(f"c_{name}") for name in fields],
    ).where("s.cmp is not null")
    sums = signed.groupBy(*by, F.col("s.cmp").alias("cmp")).agg(F.sum("s.sign").alias("presence"), *[F.sum(F.col("s.sign") * F.col(f"c_{name}")).alias(f"d_{name}") for name in fields])
    moved = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"d_{name}") != 0, F.lit(name)) for name in fields])))
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").when(F.size(moved) > 0, "changed")
    return sums.select(F.col("cmp").alias(number), *by, kind.alias("change_kind"), F.when(F.col("presence") == 0, moved).alias("changed_fields")).where("change_kind is not null")


#: Fields of a listed posting; True where letter case does not count.
LISTING_FIELDS = {"content_hash": True, "status": False, "first_seen_at": False}


def listing_changes(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """changes() over the postings listed weekly by each source."""
    return changes(snapshots, log, {name: F.lower(name) if fold else F.col(name) for name, fold in LISTING_FIELDS.items()})
