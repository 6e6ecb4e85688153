"""Hard negatives: predictions on images known to be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s


def prediction_summary(detections: DataFrame, images: DataFrame, key: str = "image") -> DataFrame:
    """One row an image: best confidence and count per class, and the top class (the first on ties, none without any)."""
    d = detections.groupBy(key).agg(
        F.max(F.when(F.col("cls") == 0, F.col("conf"))).alias("fire_conf"), F.max(F.when(F.col("cls") == 1, F.col("conf"))).alias("smoke_conf"),
        F.count_if(F.col("cls") == 0).alias("fire_count"), F.count_if(F.col("cls") == 1).alias("smoke_count"),
    )
    rows = images.select(key).distinct().join(d, key, "left").fillna(0, ["fire_conf", "smoke_conf", "fire_count", "smoke_count"])
    rows = rows.withColumn("top_conf", F.greatest("fire_conf", "smoke_conf"))
    top = F.when(F.col("top_conf") <= 0, "none").when(F.col("fire_conf") >= F.col("smoke_conf"), "fire").otherwise("smoke")
    return rows.withColumn("top_class", top)


def merge_models(frames: dict[str, DataFrame], key: str = "image") -> DataFrame:
    """``key`` and per model its top_conf and top_class; only images all models saw."""
    out = None
    for name, df in frames.items():
        own = df.select(key, F.col("top_conf").alias(f"{name}_top_conf"), F.col("top_class").alias(f"{name}_top_class"))
        out = own if out is None else out.join(own, key)
    return out


def classify(rows: DataFrame, models: list[str]) -> DataFrame:
    """Votes, consensus class, severity and hardness of merged model rows."""
    confs = F.array(*(F.col(f"{m}_top_conf") for m in models))
    tally = lambda c: sum((F.when((F.col(f"{m}_top_conf") >= 0.25) & (F.col(f"{m}_top_class") == c), 1).otherwise(0) for m in models[1:]), F.when((F.col(f"{models[0]}_top_conf") >= 0.25) & (F.col(f"{models[0]}_top_class") == c), 1).otherwise(0))
    rows = rows.withColumns({"votes_010": s.votes(confs, 0.10), "votes_025": s.votes(confs, 0.25), "votes_050": s.votes(confs, 0.50), "max_conf": F.array_max(confs), "mean_conf": s.mean_of(confs), "fire_votes": tally("fire"), "smoke_votes": tally("smoke")})
    agreed = F.when((F.col("fire_votes") == 0) & (F.col("smoke_votes") == 0), "none").when(F.col("fire_votes") > F.col("smoke_votes"), "fire").when(F.col("smoke_votes") > F.col("fire_votes"), "smoke").otherwise("mixed")
    return rows.withColumns({"consensus_class": agreed, "severity": s.ensemble_severity(confs), "hardness": s.hardness(confs)})


def alert_rates(alerts: DataFrame, images: int | Column, thresholds: list[float], key: str = "image", classes: dict[str, object] | None = None, by: list[str] = ()) -> DataFrame:
    """Per threshold: images with any alert, per class and in all, their share of the images, and boxes.

    ``alerts``: key, cls, conf.  One pass: each image's best confidence decides for
    every threshold; thresholds are a short list.
    """
    classes = classes or {"fire": 0, "smoke": 1}
    tops = [F.max(F.when(F.col("cls") == v, F.col("conf"))).alias(f"_top_{n}") for n, v in classes.items()]
    boxes = [F.count_if(F.col("conf") >= t).alias(f"_boxes_{i}") for i, t in enumerate(thresholds)]
    per = alerts.groupBy(*by, key).agg(F.max("conf").alias("_top"), *tops, *boxes)
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_boxes_{i}").alias("boxes")) for i, t in enumerate(thresholds))))
    rows = per.select(*by, "_top", *(f"_top_{n}" for n in classes), each.alias("e")).select("*", "e.*")
    counts = [F.count_if(F.col("_top") >= F.col("threshold")).alias("alert_images"), *(F.count_if(F.col(f"_top_{n}") >= F.col("threshold")).alias(f"{n}_alert_images") for n in classes)]
    out = rows.groupBy(*by, "threshold").agg(*counts, F.sum("boxes").alias("alert_boxes"))
    total = images if isinstance(images, Column) else F.lit(images)
    return out.withColumns({"images": total.cast("long"), "image_rate": s.ratio("alert_images", total), **{f"{n}_image_rate": s.ratio(f"{n}_alert_images", total) for n in classes}})


def by_threshold(rates: DataFrame, by: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """One column a threshold, named by its tag."""
    tags = [f"{t:.2f}".replace(".", "") for t in thresholds]
    return rates.withColumn("_tag", s.threshold_tag("threshold")).groupBy(*by).pivot("_tag", tags).agg(F.first(value))


def relative_reduction(rates: DataFrame, baseline: DataFrame, on: str, value: str) -> DataFrame:
    """``rates`` with the baseline's value, the difference and its share; null without a baseline row."""
    b = baseline.select(on, F.col(value).alias("baseline"))
    rows = rates.join(b, on, "left")
    return rows.withColumns({"delta": F.col(value) - F.col("baseline"), "reduction": F.try_divide(F.col("baseline") - F.col(value), F.col("baseline"))})


def residual_split(rows: DataFrame, conf: str = "top_conf", least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Rows to be reviewed and the rest."""
    return rows.where(F.col(conf) >= least), rows.where(~(F.coalesce(F.col(conf), F.lit(0.0)) >= least))


def review_decisions(rows: DataFrame, decisions: DataFrame, key: str = "image") -> DataFrame:
    """Human decisions (key, status) beside the rows: approve, relabel or quarantine; others count as none."""
    known = decisions.select(key, F.lower(F.trim("status")).alias("status")).where(F.col("status").isin("approve", "relabel", "quarantine"))
    return rows.join(known, key, "left")


def update_queue(queue: DataFrame, changes: DataFrame, key: str = "image", columns=("status", "note"), order: str = "at") -> DataFrame:
    """A review queue after its changes: the latest change of a row sets its columns; changes of unknown rows are ignored.

    The queue is a table: write the result beside it and put it in its place.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_c"))
    joined = queue.join(last, key, "left")
    return joined.select(*(F.coalesce(F.col("_c")[c], F.col(c)).alias(c) if c in columns else c for c in queue.columns))


def included(rows: DataFrame, plain: list[str], category: str = "category", status: str = "status") -> DataFrame:
    """``rows`` with include and why: by category, or by approval."""
    by_kind, by_hand = F.col(category).isin(*plain), F.coalesce(F.col(status) == "approve", F.lit(False))
    return rows.withColumns({"include": by_kind | by_hand, "why": F.when(by_kind, "category").when(by_hand, "approved").otherwise("not_approved")})
