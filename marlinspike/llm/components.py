"""Union-find grouping as distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node in an edge list; component is the smallest node reachable.

    Alternating large-star and small-star rounds on the edge list: each links a node's neighbours to its
    smallest one, so no group's edges are ever gathered in one row or on the driver and the number of rounds
    grows with the logarithm of the longest chain. Groupings are plain minimum aggregations, pre-aggregated
    before the shuffle. Each round is cut by checkpoint() in the shared folder, so a lost executor repeats one
    round at most. Null ends drop out, repeated edges and loops are harmless, an empty list gives no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null").distinct().checkpoint()
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = None
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour of u is linked to the smallest node around u.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.union(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle; raise rounds")
    root = links.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("m", "node").alias("component"))
