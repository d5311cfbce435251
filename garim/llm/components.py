"""Connected components as Spark joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garim.llm.shared import discard, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); all nodes of a component get one root,
    which is a node of it. Self-loops and repeated edges are allowed; null ends are ignored.

    Every round maps each node to the neighbour (or itself) of least hash and replaces the edges by
    their images. The image of a connected graph is connected, so no link is lost, and a new hash
    each round makes chains shrink by a constant factor and stars collapse at once. Each round is an
    aggregate with map-side combine and two joins; hubs are split by the skew-join rule of adaptive
    execution.
    """
    given = edges = saved(edges.where("a is not null and b is not null").select("a", "b"), "links")
    names = saved(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "nodes")
    live = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    discard(given)
    turn = 0
    while live.head(1):
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("n"))
        ends = live.select("a", "b").union(live.select("b", "a"))
        to = ends.groupBy("a").agg(F.min(order(F.col("b"))).alias("m")).select(
            F.col("a").alias("n"), F.least(F.col("m"), order(F.col("a")))["n"].alias("to")
        )
        to = saved(to, "moves")
        left = to.select(F.col("n").alias("a"), F.col("to").alias("ta"))
        right = to.select(F.col("n").alias("b"), F.col("to").alias("tb"))
        moved = live.join(left, "a").join(right, "b").where("ta <> tb")
        after = saved(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        renamed = saved(
            names.join(to.select(F.col("n").alias("root"), "to"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "nodes",
        )
        for old in (live, names, to):
            discard(old)
        live, names = after, renamed
    discard(live)
    return names
