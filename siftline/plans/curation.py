"""Whole pipelines made of operators: layered clean manifests, and the final evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import size_bucket
from ..operators import dedup, evaluate, leakage, manifest, matching
from .storage import stored


def layered_manifest(items: DataFrame, pairs: DataFrame, edges: DataFrame, key: str = "stem") -> DataFrame:
    """``layer, split, key``: from all items to the frozen layer.

    ``pairs``: compared duplicates (key_a, split_a, key_b, split_b, result), or what leaves because of them (key, split, role);
    ``edges``: leakage edges (a, b, split_a, split_b).  Exact duplicates go first, then
    what touches test, then what touches val among the edges still alive.
    """
    base = items.select("split", key)
    gone = stored(pairs if "role" in pairs.columns else dedup.removals(dedup.decide(pairs, key), key), "removals")
    clean = manifest.without(base, gone, ("split", key))
    named = clean.withColumnRenamed(key, "key")
    first = stored(leakage.direct_exclusion(leakage.alive(edges, named), "test"), "test_leaks")
    protected = manifest.without(named, first, ("split", "key"))
    second = leakage.direct_exclusion(leakage.alive(edges, protected), "val").where("split <> 'test'")
    frozen = manifest.without(protected, stored(second, "val_leaks"), ("split", "key"))
    layers = {
        "original": base, "exclude_exact": gone.where("role = 'exclude'").select("split", key), "quarantine_exact": gone.where("role = 'quarantine'").select("split", key), "clean_exact": clean,
        "clean_test_protected": protected.withColumnRenamed("key", key), "frozen": frozen.withColumnRenamed("key", key),
    }
    return manifest.stack(layers)


def final_evaluation(gts: DataFrame, preds: DataFrame, images: DataFrame, conf: float = 0.25, least_iou: float = 0.5) -> DataFrame:
    """One row: recall per class and in the mean, size-aware counts, and alerts on images without truths.

    ``gts``: image, id, cls, share, box; ``preds``: the same and conf; ``images``: image.
    The prediction ids must be known: a foreign image fails the pre-flight count.
    """
    foreign = preds.join(images, "image", "left_anti").agg(F.count("*").alias("foreign_predictions"))
    m = stored(matching.match_detections(gts, preds, ["image", "cls"], least_iou), "matches")
    sized = lambda d: d.withColumn("size", size_bucket("share"))
    by_size = evaluate.size_aware(m, sized(gts), sized(preds), [conf])
    recall = by_size.groupBy("cls").agg((F.sum("tp") / F.sum("gt")).alias("recall"))
    sizes = by_size.agg(F.sort_array(F.collect_list(F.struct("cls", "size", "gt", "tp", "prediction_fp"))).alias("by_size"))
    classes = recall.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cls", "recall")))).alias("recall"), F.avg("recall").alias("macro_recall"))
    empty = images.join(gts.select("image"), "image", "left_anti")
    alerts = evaluate.negative_rate(empty, preds, [conf]).select("images", "alert_images", "image_rate", "fire_image_rate", "smoke_image_rate")
    out = foreign
    for part in (classes, sizes, alerts.withColumnRenamed("images", "negative_images")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
