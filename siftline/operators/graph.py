"""Graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import drop_stored, scratch, stored


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an undirected edge table; a component is named by its smallest node.

    Nodes are of any type that has an order, such as numbers or strings.

    Labels sink along edges, hook onto the labels of neighbours and are then
    shortened (pointer jumping), so a path of n nodes takes about log n rounds.
    Each round is joins between stored tables and mergeable minima: a hub's rows
    can be split by the skew join and are pre-aggregated before they move.
    Null ends and self-loops are ignored.
    """
    with scratch() as keep:
        e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        label = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
        for _ in range(max_rounds):
            # the smallest label next to each node
            own = label.select("node", "label")
            near = both.join(own.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
            offers = near.join(own.withColumnRenamed("node", "u"), "u").where("m < label")
            # a better label is offered to the node and to the root it hangs on
            offers = offers.select(F.explode(F.array("u", "label")).alias("node"), F.col("m").alias("label"))
            offered = own.withColumn("was", F.col("label")).unionByName(offers, allowMissingColumns=True)
            hooked = stored(offered.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")), "labels")
            up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
            short = stored(hooked.join(up, "label", "left").select("node", F.least("label", "up").alias("label"), "was"), "labels")
            done = short.where("label <> was").limit(1).count() == 0  # the label before travels along: no join
            drop_stored(hooked)
            drop_stored(label)
            label = short
            if done:
                return keep(label).select("node", F.col("label").alias("component"))
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
