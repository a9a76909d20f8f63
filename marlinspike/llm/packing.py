"""Filling fixed-capacity containers: optimal length buckets by dynamic programming, token-budget batches over them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most `buckets` length buckets that minimise padding, sum of count x (bound - length).

    Dynamic programming over the sorted histogram with prefix sums; the last bound is the greatest length.
    """
    n = len(lengths)
    k = min(buckets, n)
    if k == n:
        return lengths.copy()
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    s = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.float64)])
    best = lengths * c[1:] - s[1:]
    cuts = np.zeros((k, n), dtype=np.int32)
    for level in range(1, k):
        now = best.copy()
        # The best cut moves right with the last length: midpoints narrow the search of both halves, all halves of one depth at once.
        lo, hi, least, most = (np.array([x]) for x in (level, n - 1, level - 1, n - 2))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(most, mid - 1) - least + 1
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            own = np.repeat(np.arange(len(mid)), size)
            i = np.arange(size.sum()) - at[own] + least[own]
            j = mid[own]
            cost = best[i] + lengths[j] * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1])
            lowest = np.minimum.reduceat(cost, at)
            hits = np.flatnonzero(cost == lowest[own])
            _, first = np.unique(own[hits], return_index=True)
            cut = i[hits[first]]
            now[mid], cuts[level, mid] = lowest, cut + 1
            left, right = lo < mid, mid < hi
            lo, hi, least, most = (np.concatenate([x[left], y[right]]) for x, y in ((lo, mid + 1), (mid - 1, hi), (least, cut), (cut, most)))
        best = now
    bounds, j, level = [], n - 1, k - 1
    while True:
        bounds.append(lengths[j])
        if level == 0 or j == 0:
            break
        j = cuts[level, j] - 1
        level = min(level - 1, j)
    return np.array(bounds[::-1])


def fill_plan(bounds: np.ndarray, counts: np.ndarray, capacity: int, top_up: bool = True) -> list[dict[str, int]]:
    """How containers are filled: rows of (bucket, first, items, per, container, place).

    Items `first` .. `first` + `items` - 1 of a bucket go `per` to a container, into containers from number
    `container` on, from place `place` on. Batches form inside a bucket by token budget, from the longest bucket
    down: a container takes as many items of the bucket as the budget allows. With top_up the room that a batch
    leaves is filled by a batch of the next shorter bucket that fits, and so on; one such mixture is repeated
    while its buckets last, so the plan's size depends on the number of buckets and not of items.
    """
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), dtype=np.int64)
    plan, container = [], 0
    while left.any():
        room, mix = capacity, []
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                take = int(min(left[b], room // bounds[b]))
                mix.append((b, take))
                room -= take * int(bounds[b])
                if not top_up:
                    break
        times = min(int(left[b]) // take for b, take in mix)
        place = 1
        for b, take in mix:
            plan.append({"bucket": b, "first": int(used[b]), "items": take * times, "per": take, "container": container, "place": place})
            left[b] -= take * times
            used[b] += take * times
            place += take
        container += times
    return plan


@dataclass
class PackPlan:
    """The bucket bounds of one pack size and how its containers are filled, from the histogram of lengths."""

    capacity: int
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    steps: list[dict[str, int]] = field(default_factory=list)
    containers: int = 0
    whole: int = 0
    padding_share: float | None = None
    inside_unused_share: float | None = None

    @classmethod
    def of(cls, capacity: int, histogram: list[tuple[int, int]], whole: int, buckets: int, top_up: bool) -> PackPlan:
        """whole: full containers of pieces of longer texts, which stand apart from the buckets."""
        if not histogram:
            return cls(capacity, whole=whole)
        lengths, counts = (np.array(x, dtype=np.int64) for x in zip(*sorted(histogram)))
        bounds = optimal_buckets(lengths, counts, buckets)
        held = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds)).astype(np.int64)
        steps = fill_plan(bounds, held, capacity, top_up)
        tokens = int((lengths * counts).sum())
        inside = int((-(-held // (capacity // bounds))).sum())
        return cls(
            capacity, bounds, steps, max(p["container"] + p["items"] // p["per"] for p in steps), whole,
            round(float((held * bounds).sum() - tokens) / tokens, 6), round(1 - (tokens + whole * capacity) / ((inside + whole) * capacity), 6),
        )


def _pieces(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(pack_name, capacity, id, full, rest): how many full pieces a text gives in each pack size, and what is left of it."""
    packs = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(c).alias("capacity")) for name, c in capacities.items()])
    each = sizes.select("id", "tokens", F.explode(packs).alias("p")).select("p.pack_name", "p.capacity", "id", "tokens")
    return each.select("pack_name", "capacity", "id", F.floor(F.col("tokens") / F.col("capacity")).cast("int").alias("full"), (F.col("tokens") % F.col("capacity")).cast("int").alias("rest"))


def plan_packs(sizes: DataFrame, capacities: dict[str, int], buckets: int = 96, top_up: bool = True) -> dict[str, PackPlan]:
    """The plan of each pack size, from one histogram query; the driver holds at most a row per length and pack size."""
    if not 1 <= len(capacities) <= 100 or any(c < 1 for c in capacities.values()):
        raise ValueError("one to 100 pack sizes, each of a token or more")
    totals = _pieces(sizes.where("tokens > 0"), capacities).groupBy("pack_name", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()
    return {
        name: PackPlan.of(c, [(r["rest"], r["n"]) for r in totals if r["pack_name"] == name and r["rest"]], sum(r["full"] for r in totals if r["pack_name"] == name), buckets, top_up)
        for name, c in capacities.items()
    }


def pack(sizes: DataFrame, capacities: dict[str, int], buckets: int = 96, rows_per_task: int = 100_000, top_up: bool = True, plans: dict[str, PackPlan] | None = None) -> DataFrame:
    """(pack_name, id, piece, container, place, tokens, unused): where each text goes in containers of each pack size.

    sizes: (id, tokens) with each id once, as from count_tokens(); capacities: pack name -> tokens. A text of at
    most the capacity is piece 1 and never split; a longer one gives full pieces that fill containers of their
    own and a last piece that is packed as any text. Texts without tokens take no place: container, place and
    unused are null. unused is what the piece's whole container leaves free. An empty table gives no rows; ties
    are settled by id. With top_up=False batches stay inside their buckets, as the plain method has it; a text
    of over half the capacity then has a container to itself.

    All pack sizes run in one plan, the size being part of every key. Items are numbered inside their bucket by
    a count per (pack, bucket, salt) and a row number inside, so a bucket that holds a third of all rows is
    spread over many tasks.
    """
    spark = sizes.sparkSession
    plans = plans or plan_packs(sizes, capacities, buckets, top_up)
    known = sizes.where("tokens > 0").select("id", "tokens")
    items = sum(p["items"] for plan in plans.values() for p in plan.steps) + sum(plan.whole for plan in plans.values())
    packs = F.explode(F.array(*[F.lit(name) for name in capacities])).alias("pack_name")
    nothing = sizes.where("tokens is null or tokens <= 0").select(packs, "id", F.lit(1).alias("piece"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("int").alias("unused"))
    if not items:
        return nothing
    salts = max(8, -(-items // (rows_per_task * max(1, len(capacities)))))
    edges = F.create_map(*[x for name, plan in plans.items() for x in (F.lit(name), F.lit([int(b) for b in plan.bounds]).cast("array<int>"))])
    bucket = F.size(F.filter(F.element_at(edges, F.col("pack_name")), lambda x: x < F.col("rest")))
    pieces = _pieces(known, capacities).select("pack_name", "capacity", "id", "full", "rest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    group = ["pack_name", "bucket", "salt"]

    def numbered(rows: DataFrame, size: str) -> DataFrame:
        """Rows with `before`: the sum of `size` over the rows of lower salt, then lower id, in their pack and bucket."""
        per = rows.groupBy(*group).agg(F.sum(size).alias("n"))
        offset = per.select(*group, (F.sum("n").over(Window.partitionBy("pack_name", "bucket").orderBy("salt")) - F.col("n")).alias("offset"))
        inside = F.sum(size).over(Window.partitionBy(*group).orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offset, group).withColumn("before", F.col("offset") + F.col("inside"))

    rests = numbered(pieces.where("rest > 0").withColumn("bucket", bucket).withColumn("one", F.lit(1)), "one")
    steps = spark.createDataFrame([(name, *p.values()) for name, plan in plans.items() for p in plan.steps], "pack_name string, bucket int, first long, items long, per int, container long, place int")
    at = F.col("before") - F.col("first")
    ends = rests.alias("r").join(steps.alias("s"), (F.col("r.pack_name") == F.col("s.pack_name")) & (F.col("r.bucket") == F.col("s.bucket")) & (F.col("before") >= F.col("first")) & (F.col("before") < F.col("first") + F.col("items")))
    ends = ends.select("r.pack_name", "capacity", "id", (F.col("full") + 1).alias("piece"), (F.col("container") + F.floor(at / F.col("per"))).cast("long").alias("container"), (F.col("place") + at % F.col("per")).cast("int").alias("place"), F.col("rest").cast("long").alias("tokens"))
    # Full pieces: their containers follow those of the plan.
    after = F.element_at(F.create_map(*[F.lit(x) for name, plan in plans.items() for x in (name, plan.containers)]), F.col("pack_name"))
    wholes = numbered(pieces.where("full > 0").withColumn("bucket", F.lit(-1)), "full").select("pack_name", "capacity", "id", "before", F.posexplode(F.sequence(F.lit(1), F.col("full"))).alias("at", "piece"))
    wholes = wholes.select("pack_name", "capacity", "id", "piece", (after + F.col("before") + F.col("at")).cast("long").alias("container"), F.lit(1).alias("place"), F.col("capacity").cast("long").alias("tokens"))
    filled = F.sum("tokens").over(Window.partitionBy("pack_name", "container"))
    return ends.union(wholes).select("pack_name", "id", "piece", "container", "place", "tokens", (F.col("capacity") - filled).cast("int").alias("unused")).union(nothing)


def unused_space(packed: DataFrame, plans: dict[str, PackPlan]) -> DataFrame:
    """(pack_name, containers, tokens, unused, unused_share, padding_share, inside_unused_share) of each pack size that holds anything.

    padding_share is what the buckets' bounds add to the texts' tokens; inside_unused_share is the space that
    batches kept inside their buckets would leave unused.
    """
    spark = packed.sparkSession
    known = spark.createDataFrame([(name, p.capacity, p.padding_share, p.inside_unused_share) for name, p in plans.items()], "pack_name string, capacity int, padding_share double, inside_unused_share double")
    by = packed.where("container is not null").groupBy("pack_name").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.join(known, "pack_name").select(
        "pack_name", "containers", "tokens", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"),
        F.round(1 - F.try_divide(F.col("tokens"), F.col("containers") * F.col("capacity")), 6).alias("unused_share"), "padding_share", "inside_unused_share",
    )
