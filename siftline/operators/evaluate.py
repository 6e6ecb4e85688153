"""Evaluation of predictions against truths, and of two runs against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import ratio
from .dedup import rank_within, with_rank
from .matching import match_detections


#: Values that an exact percentile may hold in one task.
GATHERED = 1_000_000


def size_aware(matches: DataFrame, gts: DataFrame, preds: DataFrame, thresholds: list[float], by: list[str] = ("cls", "size")) -> DataFrame:
    """Per threshold, class and size: truths found and missed, predictions right and wrong.

    ``matches``: gt_id, pred_id, conf of one matching at the lowest threshold;
    ``gts``: id, cls, size; ``preds``: id, cls, size, conf.  A right prediction counts
    under its truth's size, a wrong one under its own.
    """
    steps = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    hits = matches.where("gt_id is not null and pred_id is not null").select("gt_id", "pred_id", F.col("conf").alias("m_conf"))
    g = gts.join(hits, gts["id"] == hits["gt_id"], "left").select(*by, "m_conf", steps)
    found = F.coalesce(F.col("m_conf") >= F.col("threshold"), F.lit(False))
    left = g.groupBy("threshold", *by).agg(F.count("*").alias("gt"), F.count_if(found).alias("tp"), F.avg(F.when(found, F.col("m_conf"))).alias("tp_mean_conf"))
    right_ids = hits.select(F.col("pred_id").alias("id"))
    wrong = preds.join(right_ids, "id", "left_anti").select(*by, "conf", steps).where(F.col("conf") >= F.col("threshold"))
    right = wrong.groupBy("threshold", *by).agg(F.count("*").alias("prediction_fp"))
    rows = left.join(right, ["threshold", *by], "full").fillna(0, ["gt", "tp", "prediction_fp"])
    rows = rows.withColumns({"fn": F.col("gt") - F.col("tp"), "gt_recall": ratio("tp", "gt"), "prediction_tp": F.col("tp")})
    return rows.withColumn("predicted_boxes", F.col("tp") + F.col("prediction_fp")).withColumn("predicted_precision", ratio("tp", "predicted_boxes"))


def macro_recall(rows: DataFrame, by: list[str], value: str = "gt_recall") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("macro_recall"))


def negative_rate(negatives: DataFrame, preds: DataFrame, thresholds: list[float], key: str = "image") -> DataFrame:
    """Share of the images without truths that raise an alert, per threshold and class."""
    from .mining import alert_rates

    own = preds.join(negatives.select(key), key, "left_semi")
    return alert_rates(own, negatives.select(key).distinct().count(), thresholds, key)


def agreement(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.95) -> DataFrame:
    """One row: how two runs' detections (keys, id, conf, box) match one to one.

    Every detection of run a, by confidence, takes the free one of b with the
    largest IoU.  Without a match the largest difference is infinite.
    """
    m = match_detections(b, a, keys, least)
    hit = F.col("gt_id").isNotNull() & F.col("pred_id").isNotNull()
    other = b.select(F.col("id").alias("gt_id"), F.col("conf").alias("other_conf"))
    rows = m.join(other, "gt_id", "left")
    gap = F.when(hit, F.abs(F.col("conf") - F.col("other_conf")))
    out = rows.agg(F.count_if(F.col("pred_id").isNotNull()).alias("n_a"), F.count_if(F.col("gt_id").isNotNull()).alias("n_b"), F.count_if(hit).alias("matched"), F.avg(F.when(hit, F.col("iou"))).alias("mean_iou"), F.avg(gap).alias("mean_conf_delta"), F.max(gap).alias("max_conf_delta"))
    return out.withColumns({"match_rate": F.col("matched") / F.greatest("n_a", "n_b", F.lit(1)), "max_conf_delta": F.coalesce("max_conf_delta", F.lit(float("inf")))})


def largest_delta(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """One row: the largest absolute difference over the metric columns."""
    both = a.select(*on, *(F.col(c).alias(f"{c}_a") for c in columns)).join(b.select(*on, *(F.col(c).alias(f"{c}_b") for c in columns)), on)
    return both.agg(F.max(F.greatest(*(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in columns), F.lit(0.0))).alias("max_delta"))


def gate(checks: dict) -> list:
    """Columns for named boolean checks and PASS or FAIL over all of them."""
    every = F.forall(F.array(*checks.values()), lambda x: F.coalesce(x, F.lit(False)))
    return [*(c.alias(n) for n, c in checks.items()), F.when(every, "PASS").otherwise("FAIL").alias("verdict")]


def latency(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Mean, median, p95, p99, smallest and largest; percentiles are exact and interpolated."""
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    exact = percentiles(rows, value, by, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    match = F.lit(True)
    for c in by:
        match = match & plain[c].eqNullSafe(exact[c])
    both = plain.join(exact, match) if by else plain.crossJoin(F.broadcast(exact))  # one row without groups
    return both.select(*(plain[c] for c in by), "n", "mean", "median", "p95", "p99", "min", "max")


def percentiles(rows: DataFrame, value: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """Exact, interpolated percentiles per group.

    Up to ``GATHERED`` values, which is checked, an aggregate gathers them; beyond,
    the values are ranked and only those beside each percentile are looked at.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    if known.limit(GATHERED + 1).count() <= GATHERED:
        return known.groupBy(*by).agg(*(F.percentile(value, F.lit(q)).alias(name) for name, q in wanted.items()))
    if by:
        ranked = rank_within(known, list(by), [F.col(value)], "_i", size="_n")
    else:
        ranked = with_rank(known, [F.col(value)], "_i").withColumn("_n", F.lit(known.count()))
    at = {name: (F.col("_n") - 1) * F.lit(q) for name, q in wanted.items()}
    place = F.col("_i") - 1
    near = F.lit(False)
    for x in at.values():
        near = near | (place == F.floor(x)) | (place == F.ceil(x))
    cut = {name: F.max(F.when(place == F.floor(x), F.col(value))) + (F.max(F.when(place == F.ceil(x), F.col(value))) - F.max(F.when(place == F.floor(x), F.col(value)))) * F.max(x - F.floor(x)) for name, x in at.items()}
    return ranked.where(near).groupBy(*by).agg(*(c.alias(n) for n, c in cut.items()))


def ranked(rows: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Models ranked by a metric, ties alike; the table has a row a model."""
    return rows.withColumn(name, F.rank().over(Window.orderBy(F.desc(value))))


def majority_mapping(counts: DataFrame, source: str, target: str, n: str = "n") -> DataFrame:
    """For each source value the target it goes with most often, and that target's share."""
    return counts.groupBy(source).agg(F.max_by(target, F.struct(F.col(n), F.col(target))).alias(target), F.max(n).alias("votes"), F.sum(n).alias("total")).withColumn("share", ratio("votes", "total"))
