"""Leakage between splits: scored pairs, component reports, removal by direct edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions.scoring import component_type
from .graph import connected_components
from .matching import global_match, match_summary


def score_pairs(pairs: DataFrame, a: str = "boxes_a", b: str = "boxes_b", tolerance: float = 1e-6) -> DataFrame:
    """Pairs with their box agreement, tier, state and priority.

    ``pairs``: corr, mae, psnr, color and two box arrays (struct cls, box).  The match
    at IoU .5 is a prefix of the one at .3, as pairs are taken from the best down.
    """
    x, y = F.col(a), F.col(b)
    rows = pairs.withColumn("_m30", global_match(x, y, 0.30)).withColumn("_m50", F.filter("_m30", lambda m: m["iou"] >= 0.50))
    classes = lambda q: F.array_sort(F.transform(q, lambda v: v["cls"]))
    sides = ("x1", "y1", "x2", "y2")

    def close(p, q):
        ok = p["cls"] == q["cls"]
        for c in sides:
            ok = ok & (F.abs(p["box"][c] - q["box"][c]) <= tolerance)
        return F.coalesce(ok, F.lit(False))

    same = (F.size(x) == F.size(y)) & F.forall(F.zip_with(F.array_sort(x), F.array_sort(y), close), lambda ok: ok)
    rows = rows.withColumns({"match30": match_summary(x, y, F.col("_m30")), "match50": match_summary(x, y, F.col("_m50"))})
    rows = rows.withColumn("state", s.annotation_state(same, classes(x) == classes(y), F.size(x) == F.size(y), "match30", "match50"))
    rows = rows.withColumn("tier", s.image_tier("corr", "mae", "psnr", "color"))
    return rows.withColumn("priority", s.leakage_priority("tier", "state")).drop("_m30", "_m50")


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges ``x, y``, both ways round."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    return e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def members(edges: DataFrame, splits: DataFrame, a: str = "a", b: str = "b", key: str = "node") -> DataFrame:
    """``component, node, split, degree, test_neighbors, direct_test_neighbor``; degree counts distinct neighbours."""
    component = connected_components(edges, a, b)
    both = undirected(edges, a, b)
    other = splits.select(F.col(key).alias("y"), F.col("split").alias("y_split"))
    near = both.join(other, "y").groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree"), F.count_if(F.col("y_split") == "test").alias("test_neighbors"))
    rows = component.join(near, "node").join(splits.select(F.col(key).alias("node"), "split"), "node")
    return rows.withColumn("direct_test_neighbor", (F.col("test_neighbors") > 0).cast("int"))


#: Counts of a component's edges: the column of the edge table and its values.
EDGE_COUNTS = {
    "priority": {"VERY_HIGH": "very_high_edges", "HIGH": "high_edges"},
    "tier": {"EXTREME": "extreme_edges", "ULTRA": "ultra_edges"},
    "state": {"EXACT": "annotation_exact", "STRONG": "annotation_strong", "MODERATE": "annotation_moderate", "CONFLICT": "annotation_conflict"},
    "relation": {"train_val": "train_val_edges", "train_test": "train_test_edges", "val_test": "val_test_edges"},
}


def edge_stats(edges: DataFrame, member_rows: DataFrame, a: str = "a") -> DataFrame:
    """``component`` and the counts of its edges by priority, tier, state and relation; an edge belongs where its end does."""
    where = member_rows.select(F.col("node").alias(a), "component")
    counts = [F.count_if(F.col(c) == value).alias(name) for c, names in EDGE_COUNTS.items() for value, name in names.items()]
    return edges.join(where, a).groupBy("component").agg(*counts)


def largest(stats: DataFrame) -> DataFrame:
    """The row of the component with most nodes; of equal ones that with most edges, then the smallest name."""
    names = stats.columns
    order = stats.groupBy().agg(F.max(F.struct("nodes", "edges")).alias("m"))
    top = stats.join(F.broadcast(order), (F.col("nodes") == F.col("m.nodes")) & (F.col("edges") == F.col("m.edges")))
    return top.agg(F.min_by(F.struct(*names), "component").alias("r")).where("r is not null").select("r.*")


def component_stats(member_rows: DataFrame) -> DataFrame:
    """One row a component: nodes, edges, degrees, density, splits and type."""
    g = member_rows.groupBy("component").agg(
        F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"),
        *(F.count_if(F.col("split") == x).alias(f"n_{x}") for x in s.PRIORITY), F.array_sort(F.collect_set("split")).alias("splits"), F.sum("direct_test_neighbor").alias("direct_test_neighbors"),
        F.count_if((F.col("direct_test_neighbor") == 1) & (F.col("split") != "test")).alias("direct_non_test_nodes_to_test"),
    )
    full = F.col("nodes") * (F.col("nodes") - 1) / 2
    return g.withColumns({"density": s.ratio(F.col("edges"), full), "type": component_type("splits")})


def direct_exclusion(edges: DataFrame, protected: str, a: str = "a", b: str = "b", split_a: str = "split_a", split_b: str = "split_b") -> DataFrame:
    """``split, key``: the other ends of edges that touch the protected split; similarity isn't taken as transitive."""
    end = lambda this, other, key: F.when((F.col(this) == protected) & (F.col(other) != protected), F.struct(F.col(other).alias("split"), F.col(key).alias("key")))
    ends = edges.select(F.coalesce(end(split_a, split_b, b), end(split_b, split_a, a)).alias("end"))
    return ends.where("end is not null").select("end.split", "end.key").distinct()


def alive(edges: DataFrame, layer: DataFrame, a: str = "a", b: str = "b", key: str = "key") -> DataFrame:
    """Edges whose both ends are in a layer."""
    ends = layer.select(F.col(key).alias("_k")).distinct()
    return edges.join(ends, F.col(a) == F.col("_k"), "left_semi").join(ends, F.col(b) == F.col("_k"), "left_semi")


def surviving(edges: DataFrame, layer: DataFrame, first: str, second: str, a: str = "a", b: str = "b", key: str = "key") -> DataFrame:
    """Edges between two splits that are still in a layer: empty after a correct removal."""
    left = alive(edges, layer, a, b, key)
    return left.where(F.array(F.col("split_a"), F.col("split_b")) == F.array(F.lit(first), F.lit(second))).unionByName(left.where(F.array(F.col("split_b"), F.col("split_a")) == F.array(F.lit(first), F.lit(second))))


def surviving_counts(edges: DataFrame, layer: DataFrame, between: list[tuple[str, str]], a: str = "a", b: str = "b", key: str = "key") -> DataFrame:
    """One row: how many edges ``surviving`` lists for each two splits (``first_second``), from one pass over those alive."""
    ends = F.array_sort(F.array("split_a", "split_b"))
    counts = [F.count_if(ends == F.array(*(F.lit(x) for x in sorted(two)))).alias("_".join(two)) for two in between]
    return alive(edges, layer, a, b, key).agg(*counts)
