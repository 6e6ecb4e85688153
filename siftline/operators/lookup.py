"""Dimension lookups that count what they miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_default(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: str = "unknown") -> DataFrame:
    """``rows`` with the dimension's value, or the default where the key is missing."""
    known = dimension.select(key, F.col(value).alias("_value")).dropDuplicates([key])
    return rows.join(known, key, "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_value")


def both_sides(pairs: DataFrame, features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs (key_a, key_b) with the features of both ends and ``complete``; a pair with a missing end stays."""
    out = pairs
    for x in "ab":
        side = features.select(F.col(key).alias(f"{key}_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns), F.lit(True).alias(f"_has_{x}"))
        out = out.join(side, f"{key}_{x}", "left")
    return out.withColumn("complete", F.coalesce(F.col("_has_a") & F.col("_has_b"), F.lit(False))).drop("_has_a", "_has_b")


def failures(joined: DataFrame) -> DataFrame:
    """One row: pairs looked up and pairs that lack an end."""
    return joined.agg(F.count("*").alias("pairs"), F.count_if(~F.col("complete")).alias("failures"))


def mapping_votes(names: DataFrame, numbers: DataFrame, key: str = "stem", most: int | None = None) -> DataFrame:
    """How often a class name and a class number label the same file, where both files hold one class only.

    ``names``: key, name; ``numbers``: key, cls.  ``most`` bounds the pairs looked at,
    in the order of the key.
    """
    single = lambda d, c: d.groupBy(key).agg(F.array_distinct(F.collect_list(c)).alias("v")).where(F.size("v") == 1).select(key, F.col("v")[0].alias(c))
    pairs = single(names, "name").join(single(numbers, "cls"), key)
    if most is not None:
        pairs = pairs.orderBy(key).limit(most)
    return pairs.groupBy("cls", "name").agg(F.count("*").alias("n"))


def sums_by_category(detections: DataFrame, images: DataFrame, key: str = "image", least: float = 0.25) -> DataFrame:
    """Per image category: images, detections, strong detections, and images with one."""
    per = detections.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("conf") >= least).alias("strong"))
    rows = images.select(key, "category").join(per, key, "left").fillna(0, ["n", "strong"])
    return rows.groupBy("category").agg(F.count("*").alias("images"), F.sum("n").alias("detections"), F.sum("strong").alias("strong"), F.count_if(F.col("strong") > 0).alias("images_with_strong"))
