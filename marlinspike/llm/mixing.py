"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlinspike.session import ensure_checkpoint_dir

BINS = 1024


def rake(tokens: np.ndarray, groups: list[np.ndarray], wanted: list[np.ndarray], caps: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights per cell, at most caps, so that token sums by groups[0] are wanted[0] and the others come near.

    Classic raking from weight 1: each round scales every marginal to its wanted sums in turn and ends with the
    first one; a weight over its cap is cut, and the rest of its first group makes up for it. A first group
    whose cap is exactly its wanted sum ends with all its cells at the cap.
    """
    w = np.ones(len(tokens))
    for _ in range(rounds):
        before = w.copy()
        for g, want in [*zip(groups[1:], wanted[1:]), (groups[0], wanted[0])]:
            have = np.bincount(g, weights=w * tokens, minlength=len(want))
            w = w * np.divide(want, have, out=np.ones_like(have), where=have > 0)[g]
        for _ in range(60):
            over = w >= caps
            w = np.minimum(w, caps)
            have = np.bincount(groups[0], weights=w * tokens, minlength=len(wanted[0]))
            free = np.bincount(groups[0], weights=np.where(over, 0, w * tokens), minlength=len(wanted[0]))
            miss = wanted[0] - have
            if (np.abs(miss) <= 1e-9 * np.maximum(1, wanted[0])).all() or not free.any():
                break
            w = np.where(over, w, w * (1 + np.divide(miss, free, out=np.zeros_like(miss), where=free > 0))[groups[0]])
        w = np.clip(w, 0, caps)
        if np.abs(w - before).max(initial=0) < 1e-9:
            break
    return w


def wanted_tokens(share: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """Tokens per source: its share of the total, but no more than it can give; what small sources lack goes to the others by share."""
    want, open_ = np.zeros(len(share)), np.ones(len(share), dtype=bool)
    left = min(total, most.sum())
    while open_.any() and left > 1e-9:
        part = share * open_ / share[open_].sum() * left
        full = open_ & (want + part >= most - 1e-9)
        if not full.any():
            want += part
            break
        left -= (most - want)[full].sum()
        want[full], open_ = most[full], open_ & ~full
    return want


def exact_total(share: np.ndarray, most: np.ndarray) -> float:
    """The largest total at which every source can hold its share exactly."""
    return float((most / share).min())


def settle(miss: float, adds: list[tuple], takes: list[tuple], moves: int = 60) -> dict:
    """Changes {id: copies} that bring a source's tokens nearest to its target: always the one document more or
    less, or the swap of two, that leaves least; adds and takes are lists of (tokens, id)."""
    change: dict = {}
    adds, takes = sorted(adds), sorted(takes)
    for _ in range(moves):
        options = [(abs(miss - t), t, 0, i, None) for t, i in adds] + [(abs(miss + t), 0, t, None, i) for t, i in takes]
        sizes = np.array([t for t, _ in takes], dtype=np.float64)
        if len(sizes):
            for t, i in adds:
                k = int(np.abs(miss - t + sizes).argmin())
                if takes[k][1] != i:
                    options.append((abs(miss - t + sizes[k]), t, takes[k][0], i, takes[k][1]))
        if not options:
            break
        left, plus, minus, a, b = min(options, key=lambda o: (o[0], str(o[3]), str(o[4])))
        if left >= abs(miss):
            break
        miss += minus - plus
        if a is not None:
            change[a] = change.get(a, 0) + 1
            adds = [x for x in adds if x[1] != a]
        if b is not None:
            change[b] = change.get(b, 0) - 1
            takes = [x for x in takes if x[1] != b]
    return change


def mix(sizes: DataFrame, targets: DataFrame, marginals: Sequence[str] = ("lang", "topic"), most_cells: int = 200_000, total: float | None = None, exact: bool = False, pool: int = 300) -> DataFrame:
    """(id, source, tokens, copies) of the chosen documents, copies >= 1.

    sizes: id, source, the marginal columns, tokens, each id once; targets: source, target_share, max_repeats.
    The mixture is as large as `total`, by default all tokens the wanted sources have, so it grows with the
    corpus; a source too small for its share gives all it may (max_repeats copies of each document) and the
    others share the rest by their targets: see shares() for what came of it. With exact=True it's instead the
    largest at which every source holds its share, which one tiny source may make small. Sources without
    tokens can't hold a share: the others' shares are scaled up to sum to 1.

    Cells are (source, marginals...) with null as a value of its own; raking holds the sources to their targets
    exactly and the marginals as near as the caps allow to what the documents of the wanted sources have. A
    document gets the whole part of its cell's weight, and one more copy if it lies in the first part, by a hash
    of its id, that holds the rest of the cell's tokens. What a source then lacks or has over for the size of
    whole documents is settled by single copies among the first `pool` documents by hash, source by source.

    The driver holds one row per cell (more than most_cells raise an error). The cut in a cell is found over
    BINS sums per cell, then in one bin, so no cell is ever sorted or gathered whole, even one that holds a
    third of all rows; settling gathers 2 * pool rows of a source. Texts without tokens and sources without
    target are in no mixture; an empty table gives no rows; ties are settled by id.
    """
    spark = sizes.sparkSession
    ensure_checkpoint_dir(spark)
    names = ["source", *marginals]
    wanted_rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    known = sizes.where("tokens > 0 and id is not null").join(wanted_rows, "source")
    summed = known.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.first("share").alias("share"), F.first("cap").alias("cap")).limit(most_cells + 1).collect()
    if len(summed) > most_cells:
        raise ValueError(f"more than {most_cells} cells; use coarser marginals")
    schema = ", ".join([*(f"`{n}` {sizes.schema[n].dataType.simpleString()}" for n in names), "whole int", "rest double"])
    cells: list[tuple] = []
    goals: list[tuple] = []
    if summed:
        tokens = np.array([r["tokens"] for r in summed], dtype=np.float64)
        groups, values = [], []
        for n in names:
            index: dict = {}
            groups.append(np.array([index.setdefault(r[n], len(index)) for r in summed]))
            values.append(index)
        share, cap = np.zeros(len(values[0])), np.zeros(len(values[0]))
        for r, g in zip(summed, groups[0]):
            share[g], cap[g] = r["share"], r["cap"]
        share /= share.sum()
        most = cap * np.bincount(groups[0], weights=tokens)
        goal = wanted_tokens(share, most, exact_total(share, most) if exact else tokens.sum() if total is None else total)
        top = goal.sum()
        wanted = [goal] + [np.bincount(g, weights=tokens) / tokens.sum() * top for g in groups[1:]]
        w = rake(tokens, groups, wanted, cap[groups[0]])
        for r, x, c in zip(summed, w, cap[groups[0]]):
            whole = int(min(np.floor(x + 1e-9), c))
            rest = 0.0 if whole >= c else max(0.0, float(x - whole))
            cells.append((*[r[n] for n in names], whole, rest * float(r["tokens"])))
        goals = [(s, float(goal[g])) for s, g in values[0].items()]
    weights = spark.createDataFrame(cells, schema)
    h = F.xxhash64("id")
    rows = known.select("id", *names, "tokens", "cap", F.pmod(h, F.lit(BINS)).cast("int").alias("bin"), h.alias("h")).alias("l").join(weights.alias("r"), _same(names)).select("l.*", "r.whole", "r.rest")
    per = rows.where("rest > 0").groupBy(*names, "bin", "rest").agg(F.sum("tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*names).orderBy("bin"))
    cut = per.select(*names, "bin", "rest", (run - F.col("t")).alias("before"), run.alias("after")).where("before < rest and after >= rest").select(*names, F.col("bin").alias("cut"), F.col("before").cast("double").alias("before"))
    joined = rows.alias("l").join(cut.alias("r"), _same(names), "left").select("l.*", "r.cut", "r.before")
    inside = F.sum("tokens").over(Window.partitionBy(*names, "bin").orderBy("h", "id"))
    # Only the bin of the cut is ordered; of its documents those up to the middle of the one that crosses are taken.
    edge = joined.where("rest > 0 and bin = cut").withColumn("run", inside).withColumn("more", (F.col("before") + F.col("run") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    others = joined.where("not (rest > 0 and bin <=> cut)").withColumn("more", F.when((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), 1).otherwise(0))
    out = ["id", "source", "tokens", "cap", (F.col("whole") + F.col("more")).cast("int").alias("copies")]
    drawn = edge.select(*out).unionByName(others.select(*out)).checkpoint()
    return _settled(drawn, spark.createDataFrame(goals, f"source {sizes.schema['source'].dataType.simpleString()}, goal double"), pool)


def _settled(drawn: DataFrame, goals: DataFrame, pool: int) -> DataFrame:
    """The drawn documents, with single copies more or less that bring each source nearest to its goal."""
    missing = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("have")).join(goals, "source").select("source", (F.col("goal") - F.col("have")).alias("miss"))
    first = Window.partitionBy("source", "way").orderBy(F.xxhash64("id"), "id")
    ways = drawn.select("id", "source", "tokens", F.explode(F.array_compact(F.array(F.when(F.col("copies") < F.col("cap"), 1), F.when(F.col("copies") > 0, -1)))).alias("way"))
    near = ways.withColumn("n", F.row_number().over(first)).where(F.col("n") <= pool).join(missing, "source")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [list(zip(x["tokens"].tolist(), x["id"].tolist())) for x in (frame[frame["way"] == 1], frame[frame["way"] == -1])]
        moved = settle(float(frame["miss"].iloc[0]), *sides)
        return pd.DataFrame({"id": list(moved), "change": list(moved.values())}, columns=["id", "change"])

    changes = near.groupBy("source").applyInPandas(run, f"id {drawn.schema['id'].dataType.simpleString()}, change int")
    return drawn.join(changes, "id", "left").select("id", "source", "tokens", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("int").alias("copies")).where("copies > 0")


def _same(names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return cond


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, actual_share, most_copies) for every target; sources that gave nothing too."""
    by = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = by.agg(F.sum("tokens").alias("whole"))
    wanted = targets.select("source", "target_share", "max_repeats")
    return wanted.join(by, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)), 6).alias("actual_share"), "most_copies"
    )
