"""Layered manifests: set algebra on (layer, split, key) and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(base: DataFrame, gone: DataFrame, on=("split", "stem")) -> DataFrame:
    return base.join(gone.select(*on).distinct(), list(on), "left_anti")


def layer(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("layer", F.lit(name))


def stack(layers: dict[str, DataFrame]) -> DataFrame:
    """One long table of named layers."""
    out = None
    for name, df in layers.items():
        named = layer(df, name)
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def accounting(original: DataFrame, parts: dict[str, DataFrame], key: str = "stem") -> DataFrame:
    """One row: sizes, what is in no part, in several, or in a part only; ``holds`` if the parts partition the original."""
    tagged = original.select(key).distinct().withColumn("_o", F.lit(1)).withColumn("_p", F.lit(0))
    for df in parts.values():
        tagged = tagged.unionByName(df.select(key).distinct().withColumn("_o", F.lit(0)).withColumn("_p", F.lit(1)))
    each = tagged.groupBy(key).agg(F.max("_o").alias("o"), F.sum("_p").alias("p"))
    out = each.agg(F.sum("o").alias("n_original"), F.count_if((F.col("o") == 1) & (F.col("p") == 0)).alias("n_lost"), F.count_if(F.col("p") > 1).alias("n_overlap"), F.count_if(F.col("o") == 0).alias("n_foreign"))
    return out.withColumn("holds", (F.col("n_lost") + F.col("n_overlap") + F.col("n_foreign")) == 0)


def overlap_audit(items: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``key, n, n_splits, splits`` of the keys that stand in several splits."""
    g = items.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("splits"))
    return g.withColumn("n_splits", F.size("splits")).where("n_splits > 1")


def subset_violations(a: DataFrame, b: DataFrame, key: str = "stem") -> DataFrame:
    """Keys of a that b lacks: empty if a is a subset."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def expect_count(df: DataFrame, expected: int, strict: bool = False) -> DataFrame:
    """One row with the count and whether it is the expected one; ``strict`` makes a miss fail."""
    out = df.agg(F.count("*").alias("n")).withColumn("expected", F.lit(expected).cast("long"))
    ok = F.col("n") == F.col("expected")
    return out.withColumn("holds", F.when(ok, True).otherwise(F.raise_error(F.lit(f"expected {expected} rows")).cast("boolean")) if strict else ok)


def foreign_keys(rows: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that find their key, and the keys that are missing."""
    known = dimension.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.select(key).join(known, key, "left_anti").distinct()


def frozen_identity(counts: DataFrame, expected: DataFrame, on: list[str], value: str) -> DataFrame:
    """Counts beside their frozen values: ``state`` is same, changed, missing or unexpected."""
    a, b = counts.select(*on, F.col(value).alias("now")), expected.select(*on, F.col(value).alias("frozen"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("frozen").isNull(), "unexpected").when(F.col("now") == F.col("frozen"), "same").otherwise("changed")
    return a.join(b, on, "full").withColumn("state", state)


def split_profile(inventory: DataFrame, split: str = "split") -> DataFrame:
    """Images, boxes and classes of every split, from an image inventory."""
    cats = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("fire_only", "smoke_only", "fire_smoke", "negative")]
    return inventory.groupBy(split).agg(F.count("*").alias("images"), F.sum("box_count").alias("boxes"), *cats, F.sum("fire_total").alias("fire"), F.sum("smoke_total").alias("smoke"))


def content_hash(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """Per split the SHA-256 of its sorted values, one a line; collects a manifest's names, not its items."""
    lines = F.array_join(F.array_sort(F.collect_set(column)), "\n")
    return df.groupBy(split).agg(F.sha2(F.concat(lines, F.lit("\n")), 256).alias("sha256"), F.count_distinct(column).alias("n"))
