"""Consensus of several models: clusters, support of annotations, risk features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.scoring import MODEL_WEIGHTS, annotation_score, risk_score

_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
_STATE = f"array<struct<cls:int,models:array<string>,score:double,sum_conf:double,max_conf:double,weighted:{_BOX},plain:{_BOX},box:{_BOX}>>"
_CORNERS = ("x1", "y1", "x2", "y2")


def clusters(detections: DataFrame, key: str = "image", least_iou: float = 0.25, least_conf: float = 0.10, weighted_order: bool = False, weights: dict[str, float] = MODEL_WEIGHTS) -> DataFrame:
    """Clusters of detections (key, model, cls, conf, box) of one image and class.

    Detections come by confidence (or confidence times weight), ties by model and
    corners; each joins the cluster of largest IoU with its weighted mean box, the
    earliest on ties, among those without its model, or starts one.  One fold over the
    array of an image's detections; a cluster carries the sums its mean box is made of.
    """
    weight = F
    for m, v in weights.items():
        weight = weight.when(F.col("model") == m, F.lit(float(v)))
    rows = detections.where((F.col("conf") >= least_conf) & F.col("model").isin(*weights)).withColumn("_w", weight.otherwise(0.0))
    order = -(F.col("conf") * F.col("_w")) if weighted_order else -F.col("conf")
    item = F.struct(order.alias("order"), "model", F.struct(*(F.col(f"box.{c}").cast("double").alias(c) for c in _CORNERS)).alias("box"), F.col("cls").cast("int").alias("cls"), F.col("conf").cast("double").alias("conf"), F.col("_w").alias("w"))
    arrays = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_d"))

    def corners(f):
        return F.struct(*(f(c).alias(c) for c in _CORNERS))

    def joined(c, d):
        """The cluster ``c`` (null: none yet) with the detection ``d``."""
        models = F.array(d["model"]) if c is None else F.concat(c["models"], F.array(d["model"]))
        power = d["conf"] * d["w"]
        score = F.lit(0.0) + power if c is None else c["score"] + power
        weighted = corners(lambda k: (F.lit(0.0) if c is None else c["weighted"][k]) + d["box"][k] * d["conf"] * d["w"])
        plain = corners(lambda k: (F.lit(0.0) if c is None else c["plain"][k]) + d["box"][k])
        box = corners(lambda k: F.when(score > 0, weighted[k] / score).otherwise(plain[k] / F.size(models)))
        return F.struct(
            d["cls"].alias("cls"), models.alias("models"), score.alias("score"), (d["conf"] if c is None else c["sum_conf"] + d["conf"]).alias("sum_conf"), (d["conf"] if c is None else F.greatest(c["max_conf"], d["conf"])).alias("max_conf"),
            weighted.alias("weighted"), plain.alias("plain"), box.alias("box"),
        )

    def step(state, d):
        near = F.transform(state, lambda c: F.when((c["cls"] == d["cls"]) & ~F.array_contains(c["models"], d["model"]), iou(d["box"], c["box"])).otherwise(-1.0))
        # bound once by a lambda over one struct
        found = F.transform(F.array(F.struct(near.alias("near"))), lambda x: F.struct(F.array_max(x["near"]).alias("best"), F.array_position(x["near"], F.array_max(x["near"])).alias("at")))
        grown = lambda x: F.transform(state, lambda c, i: F.when(i + 1 == x["at"], joined(c, d)).otherwise(c))
        fits = lambda x: F.coalesce((x["best"] >= least_iou) & (x["best"] > 0), F.lit(False))
        return F.transform(found, lambda x: F.when(fits(x), grown(x)).otherwise(F.concat(state, F.array(joined(None, d)))))[0].cast(_STATE)

    made = arrays.select(key, F.explode(F.aggregate("_d", F.array().cast(_STATE), step)).alias("c"))
    n = F.size("c.models")
    return made.select(key, F.col("c.cls").alias("cls"), n.alias("votes"), F.array_sort("c.models").alias("models"), F.col("c.score").alias("score"), (F.col("c.sum_conf") / n).alias("mean_conf"), F.col("c.max_conf").alias("max_conf"), F.col("c.box").alias("box"))


def consensus(detections: DataFrame, key: str = "image", least_models: int = 2, least_mean: float = 0.10) -> DataFrame:
    """Clusters in order of weighted confidence that enough models back."""
    return clusters(detections, key, least_iou=0.30, least_conf=0.0, weighted_order=True).where((F.col("votes") >= least_models) & (F.col("mean_conf") >= least_mean))


def _arrays(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    return df.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias(name))


def risk_features(images: DataFrame, truths: DataFrame, found: DataFrame, key: str = "image", support: float = 0.20, missing: float = 0.15, conflict: float = 0.30, least_score: float = 0.35, lone: float = 0.55) -> DataFrame:
    """One row an image (key, category): how its boxes agree with the clusters.

    ``truths``: key, cls, box; ``found``: clusters.  Supports default to 1 without
    truths.
    """
    g = _arrays(truths, key, ["cls", "box"], "g")
    c = _arrays(found, key, ["cls", "votes", "score", "max_conf", "box"], "c")
    rows = images.join(g, key, "left").join(c, key, "left")
    rows = rows.withColumns({"g": F.coalesce("g", F.filter(F.expr("array(struct(0 as cls, struct(0d as x1, 0d as y1, 0d as x2, 0d as y2) as box))"), lambda x: F.lit(False))), "c": F.coalesce("c", F.filter(F.expr("array(struct(0 as cls, 0 as votes, 0d as score, 0d as max_conf, struct(0d as x1, 0d as y1, 0d as x2, 0d as y2) as box))"), lambda x: F.lit(False)))})
    rows = rows.withColumn("agreed", F.filter("c", lambda x: x["votes"] >= 2))
    top = lambda box, among: F.coalesce(F.array_max(F.transform(among, lambda x: iou(box, x["box"]))), F.lit(0.0))
    rows = rows.withColumn("s", F.transform("g", lambda b: F.struct(top(b["box"], F.filter("agreed", lambda x: x["cls"] == b["cls"])).alias("same"), top(b["box"], F.filter("agreed", lambda x: (x["cls"] != b["cls"]) & (x["score"] >= least_score))).alias("other"))))
    rows = rows.withColumn("lost", F.filter("agreed", lambda x: (x["score"] >= least_score) & (top(x["box"], F.filter("g", lambda b: b["cls"] == x["cls"])) < missing)))
    n = lambda a, f: F.size(F.filter(a, f))
    same = F.transform("s", lambda x: x["same"])
    rows = rows.withColumns(
        {
            "gt_boxes": F.size("g"),
            "gt_fire": n("g", lambda x: x["cls"] == 0),
            "gt_smoke": n("g", lambda x: x["cls"] == 1),
            "consensus_fire": n("agreed", lambda x: x["cls"] == 0),
            "consensus_smoke": n("agreed", lambda x: x["cls"] == 1),
            "missing_fire": n("lost", lambda x: x["cls"] == 0),
            "missing_smoke": n("lost", lambda x: x["cls"] == 1),
            "unsupported_gt": n("s", lambda x: x["same"] < support),
            "class_conflicts": n("s", lambda x: (x["other"] >= conflict) & (x["same"] < support)),
            "strong_singletons": n("c", lambda x: (x["votes"] == 1) & (x["max_conf"] >= lone)),
            "min_gt_support_iou": F.bround(F.coalesce(F.array_min(same), F.lit(1.0)), 6),
            "mean_gt_support_iou": F.bround(F.when(F.size("s") > 0, F.aggregate(same, F.lit(0.0), lambda a, x: a + x) / F.size("s")).otherwise(1.0), 6),
        }
    )
    risk = risk_score(F.col("missing_fire") + F.col("missing_smoke"), "unsupported_gt", "class_conflicts", "strong_singletons", "category")
    return rows.withColumn("risk_score", F.bround(risk, 4)).drop("g", "c", "agreed", "s", "lost")


def score_annotations(rows: DataFrame, truths: str, agreed: str, least: float = 0.20) -> DataFrame:
    """``rows`` with a struct ``annotation``: how an array of truths and one of consensus boxes cover each other."""
    g, c = F.col(truths), F.col(agreed)
    top = lambda x, among: F.coalesce(F.array_max(F.transform(F.filter(among, lambda y: y["cls"] == x["cls"]), lambda y: iou(x["box"], y["box"]))), F.lit(0.0))
    mine, theirs = F.transform(g, lambda x: top(x, c)), F.transform(c, lambda x: top(x, g))
    hit = lambda a: F.size(F.filter(a, lambda v: v >= least))
    ng, nc = F.size(g), F.size(c)
    gt_cov, con_cov = hit(mine) / ng, hit(theirs) / nc
    mean = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x) / ng
    both = (ng > 0) & (nc > 0)
    either = F.when((ng == 0) & (nc == 0), 1.0).otherwise(0.0)
    value = lambda v: F.when(both, v).otherwise(either)
    return rows.withColumn(
        "annotation",
        F.struct(
            value(annotation_score(gt_cov, con_cov, mean)).alias("score"), value(gt_cov).alias("gt_coverage"), value(con_cov).alias("consensus_coverage"), value(mean).alias("mean_iou"),
            F.when(both, hit(mine)).otherwise(0).alias("supported_gt"), F.when(both, ng - hit(mine)).when(nc == 0, ng).otherwise(0).alias("unsupported_gt"), F.when(both, nc - hit(theirs)).when(ng == 0, nc).otherwise(0).alias("missing_consensus"),
        ),
    )
