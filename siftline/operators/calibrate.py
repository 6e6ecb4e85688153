"""Threshold calibration: confusion counts on grids, and the best row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import confusion_ratios


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """All combinations of the axes' values, numbered in order: a small table of known size."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"_i_{name} int, {name} double")
        out = axis if out is None else out.crossJoin(axis)
    number = F.lit(0).cast("long")
    for name, values in axes.items():
        number = number * len(values) + F.col(f"_i_{name}")
    return out.withColumn("grid_index", number).drop(*(f"_i_{n}" for n in axes))


def confusion(flagged, positive) -> list[Column]:
    f, y = (F.col(c) if isinstance(c, str) else c for c in (flagged, positive))
    return [F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & ~y).alias("tn"), F.count_if(~f & y).alias("fn")]


def with_ratios(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    return counts.select("*", *confusion_ratios("tp", "fp", "tn", "fn", beta))


def on_grid(samples: DataFrame, thresholds: DataFrame, flagged: Column, positive: str = "positive", axes: list[str] | None = None) -> DataFrame:
    """Confusion counts and ratios for every row of a grid; the grid has a known size and is broadcast."""
    axes = axes or [c for c in thresholds.columns if c != "grid_index"]
    each = samples.crossJoin(F.broadcast(thresholds)).groupBy("grid_index", *axes).agg(*confusion(flagged, positive))
    return with_ratios(each)


def cumulative(samples: DataFrame, thresholds: DataFrame, score: str, positive: str = "positive", axis: str = "threshold") -> DataFrame:
    """``on_grid`` for the rule score >= threshold in one pass over the samples.

    Samples are counted by the last threshold they reach; running sums give the
    confusion of every threshold, so the cost doesn't grow with the grid.
    """
    from pyspark.sql import Window

    steps = thresholds.agg(F.array_sort(F.collect_list(axis)).alias("_steps"))
    reached = F.size(F.filter("_steps", lambda t: t <= F.col(score)))
    by = samples.crossJoin(F.broadcast(steps)).groupBy(F.coalesce(reached, F.lit(0)).alias("_k")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    ranked = thresholds.withColumn("_k", F.row_number().over(Window.orderBy(axis)))
    zero = by.withColumns({"grid_index": F.lit(None).cast("long"), axis: F.lit(None).cast("double")})
    all_ = ranked.withColumns({"p": F.lit(0).cast("long"), "n": F.lit(0).cast("long")}).unionByName(zero)
    up = Window.orderBy("_k").rangeBetween(0, Window.unboundedFollowing)
    down = Window.orderBy("_k").rangeBetween(Window.unboundedPreceding, -1)
    summed = all_.select("grid_index", axis, F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("tn"), F.coalesce(F.sum("p").over(down), F.lit(0)).alias("fn"))
    return with_ratios(summed.where("grid_index is not null"))


def best(rows: DataFrame, keys: list[Column], index: str = "grid_index") -> DataFrame:
    """The row with the largest keys, the earliest of the grid on ties."""
    picked = rows.agg(F.max_by(F.struct(*rows.columns), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), (-F.col(index)).alias("order"))).alias("r"))
    return picked.where("r is not null").select("r.*")


BY_SCORE = ("f_beta", "recall", "precision", "accuracy")
BY_TARGET = ("f_beta", "precision", "accuracy", "recall")


def grouped_search(samples: DataFrame, thresholds: DataFrame, group: str, score: str, groups: list[str], positive: str = "positive", recall: float = 0.85, precision: float = 0.35) -> DataFrame:
    """Best threshold per group by a joint grid, with ``on_target`` telling whether the constraint could be met.

    Confusion counts add up over groups: only (groups x thresholds) partial counts
    are made from the samples, and the joint grid combines those sums.
    """
    partial = samples.crossJoin(F.broadcast(thresholds)).groupBy(group, "grid_index", "threshold").agg(*confusion(F.col(score) >= F.col("threshold"), positive))
    blank = thresholds.select("grid_index", "threshold")
    joint = None
    size = None
    for g in groups:
        own = blank.join(partial.where(F.col(group) == g).drop(group, "threshold"), "grid_index", "left").fillna(0, ["tp", "fp", "tn", "fn"])
        own = own.select(F.col("grid_index").alias(f"i_{g}"), F.col("threshold").alias(f"t_{g}"), *(F.col(c).alias(f"{c}_{g}") for c in ("tp", "fp", "tn", "fn")))
        joint = own if joint is None else joint.crossJoin(F.broadcast(own))  # a grid of known size
    size = thresholds.count()
    index = F.lit(0).cast("long")
    for g in groups:
        index = index * size + F.col(f"i_{g}")
    total = lambda c: sum((F.col(f"{c}_{g}") for g in groups[1:]), F.col(f"{c}_{groups[0]}")).alias(c)
    rows = with_ratios(joint.select(index.alias("grid_index"), *(f"t_{g}" for g in groups), *map(total, ("tp", "fp", "tn", "fn"))))
    meets = (F.col("recall") >= recall) & (F.col("precision") >= precision)
    rows = rows.withColumn("on_target", meets)
    keys = [F.col("on_target")] + [F.when(F.col("on_target"), F.col(a)).otherwise(F.col(b)) for a, b in zip(BY_TARGET, BY_SCORE, strict=True)]
    return best(rows, keys)


def ensemble_rule(samples: DataFrame, thresholds: DataFrame, classes: int = 2) -> DataFrame:
    """Confusion of the rule that flags an image whose annotation an ensemble of models contradicts.

    ``samples``: present (array: is the class annotated), confs (array of the models'
    confidences for each class), weighted (array of their weighted sums) and positive.
    ``thresholds``: vote_conf, missing and unsupported.  A class that isn't annotated flags
    the image if at least two models reach vote_conf and the weighted sum reaches
    missing; one that is, if the sum stays below unsupported.  Samples alike in what
    the rule looks at (votes at each vote_conf, sums by threshold) are counted first, so the grid
    meets bins, not images.
    """
    axes = {c: F.array_sort(F.collect_set(c)).alias(f"_{c}") for c in ("vote_conf", "missing", "unsupported")}
    steps = thresholds.agg(*axes.values())
    # the grid's values: one row of known size
    x = samples.crossJoin(F.broadcast(steps))
    enough = lambda k: F.size(F.filter("_vote_conf", lambda v: F.size(F.filter(F.col("confs")[k], lambda c: c >= v)) >= 2))
    passed = lambda k, axis: F.size(F.filter(f"_{axis}", lambda t: F.col("weighted")[k] >= t))
    bins = [F.struct(F.col("present")[k].alias("there"), enough(k).alias("voted"), passed(k, "missing").alias("missed"), passed(k, "unsupported").alias("backed")).alias(f"k{k}") for k in range(classes)]
    counts = x.groupBy(*bins).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    grid = thresholds.crossJoin(F.broadcast(steps))
    nth = lambda axis: F.array_position(f"_{axis}", F.col(axis))
    grid = grid.select("grid_index", "vote_conf", "missing", "unsupported", nth("vote_conf").alias("i"), nth("missing").alias("j"), nth("unsupported").alias("k"))
    each = counts.crossJoin(F.broadcast(grid))  # bins and grid are both of known size
    flagged = F.lit(False)
    for c in range(classes):
        q = F.col(f"k{c}")
        flagged = flagged | F.when(q["there"], q["backed"] < F.col("k")).otherwise((q["voted"] >= F.col("i")) & (q["missed"] >= F.col("j")))
    total = lambda flag, side, name: F.sum(F.when(flag, F.col(side)).otherwise(0)).alias(name)
    out = each.groupBy("grid_index", "vote_conf", "missing", "unsupported").agg(total(flagged, "p", "tp"), total(flagged, "n", "fp"), total(~flagged, "n", "tn"), total(~flagged, "p", "fn"))
    return with_ratios(out)
