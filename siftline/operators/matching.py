"""Order-dependent matching of boxes, as folds over arrays in the JVM.

Boxes of one image (and class) are an array; the arrays are as long as an image
has boxes, never as long as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou

_PAIRS = "cast(array() as array<struct<a:int,b:int,iou:double>>)"


def greedy_match(gts: Column, preds: Column, least: float = 0.5) -> Column:
    """Array of (a: place of the prediction, b: place of the truth, iou).

    Predictions, already in their order, take in turn the free truth of largest
    IoU, the first on ties, if it reaches ``least``.
    """
    first = lambda acc, p, i: F.array_max(
        F.filter(
            F.transform(gts, lambda g, j: F.struct(iou(p["box"], g["box"]).alias("iou"), (-j).alias("minus"))),
            lambda c: (c["iou"] >= least) & ~F.exists(acc, lambda m: m["b"] == -c["minus"]),
        )
    )

    def step(acc, x):
        best = first(acc, x["p"], x["i"])
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(x["i"].cast("int").alias("a"), (-best["minus"]).cast("int").alias("b"), best["iou"].alias("iou")))))

    placed = F.transform(preds, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.aggregate(placed, F.expr(_PAIRS), step)


def global_match(a: Column, b: Column, least: float = 0.5) -> Column:
    """Like ``greedy_match`` over all pairs at once: the largest IoU first, ties to the later places; same class only."""
    pairs = F.flatten(
        F.transform(
            a,
            lambda x, i: F.transform(
                F.filter(F.transform(b, lambda y, j: F.struct(F.when(x["cls"] == y["cls"], iou(x["box"], y["box"])).otherwise(-1.0).alias("iou"), j.alias("j"))), lambda c: c["iou"] >= least),
                lambda c: F.struct(c["iou"].alias("iou"), i.cast("int").alias("a"), c["j"].cast("int").alias("b")),
            ),
        )
    )
    ordered = F.reverse(F.array_sort(pairs))

    def step(acc, c):
        free = ~F.exists(acc, lambda m: (m["a"] == c["a"]) | (m["b"] == c["b"]))
        return F.when(free, F.concat(acc, F.array(F.struct(c["a"].alias("a"), c["b"].alias("b"), c["iou"].alias("iou"))))).otherwise(acc)

    return F.aggregate(ordered, F.expr(_PAIRS), step)


def match_summary(a: Column, b: Column, matched: Column) -> Column:
    """struct(matched, coverage_a, coverage_b, mean_iou); an empty side is covered, two empty sides match fully."""
    n = F.size(matched)
    cover = lambda x: F.when(F.size(x) == 0, 1.0).otherwise(n / F.size(x))
    mean = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(n == 0, 0.0).otherwise(F.aggregate(matched, F.lit(0.0), lambda s, m: s + m["iou"]) / n)
    return F.struct(n.alias("matched"), cover(a).alias("coverage_a"), cover(b).alias("coverage_b"), mean.alias("mean_iou"))


def nms(boxes: Column, most: float = 0.5) -> Column:
    """Of boxes in their order, those whose IoU with all kept ones is at most ``most``."""
    empty = F.filter(boxes, lambda x: F.lit(False))
    return F.aggregate(boxes, empty, lambda kept, x: F.when(F.exists(kept, lambda k: iou(k["box"], x["box"]) > most), kept).otherwise(F.concat(kept, F.array(x))))


def per_image(rows: DataFrame, keys: list[str], order: list[Column], fields: list[str], name: str) -> DataFrame:
    """``keys, name``: the rows of each key as one array of structs, in the given order."""
    item = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *fields)
    arrays = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    return arrays.select(*keys, F.transform("_all", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def match_detections(gts: DataFrame, preds: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Greedy matching per key: one row a prediction or unmatched truth.

    ``gts``: keys, id, box; ``preds``: keys, id, conf, box.  A prefix of the
    predictions by confidence matches as the whole does, so results at a higher
    confidence threshold are a filter on ``conf`` (a truth whose match falls below
    is missed there).
    Columns: keys, gt_id, pred_id, conf, iou.
    """
    g = per_image(gts, keys, [F.col("id")], ["id", "box"], "gts")
    p = per_image(preds, keys, [-F.col("conf"), F.col("id")], ["id", "conf", "box"], "preds")
    both = g.join(p, keys, "full")
    m = both.withColumn("m", F.when(F.col("gts").isNotNull() & F.col("preds").isNotNull(), greedy_match(F.col("gts"), F.col("preds"), least)).otherwise(F.expr(_PAIRS)))
    found = m.where("preds is not null").select(*keys, "gts", F.explode(F.transform("preds", lambda x, i: F.struct(x.alias("x"), F.get(F.filter("m", lambda q: q["a"] == i), F.lit(0)).alias("q")))).alias("e"))
    found = found.select(*keys, F.get("gts", F.col("e.q.b"))["id"].alias("gt_id"), F.col("e.x.id").alias("pred_id"), F.col("e.x.conf").alias("conf"), F.col("e.q.iou").alias("iou"))
    missed = m.where("gts is not null").select(*keys, F.explode(F.filter("gts", lambda g_, i: ~F.exists("m", lambda q: q["b"] == i))).alias("g"))
    missed = missed.select(*keys, F.col("g.id").alias("gt_id"), F.lit(None).cast(found.schema["pred_id"].dataType).alias("pred_id"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("double").alias("iou"))
    return found.unionByName(missed)


def best_iou(gts: DataFrame, preds: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Per truth the largest IoU with a prediction of the same keys, 0 without one."""
    p = preds.select(*keys, F.col("box").alias("pbox"))
    pairs = gts.join(p, keys, "left").withColumn("_iou", F.coalesce(iou("box", "pbox"), F.lit(0.0)))
    return pairs.groupBy(*keys, id_col).agg(F.max("_iou").alias("best_iou"))
