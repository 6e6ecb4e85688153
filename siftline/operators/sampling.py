"""Deterministic selection: ranks, quotas, even spacing, redistribution, replay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import stable_rank
from .dedup import rank_within, with_rank


def top_k(rows: DataFrame, by: list[str], order: list, k) -> DataFrame:
    """The first k rows of each group; k is a number or a column."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", r).where(F.col("rank") <= (F.lit(k) if isinstance(k, int) else k))


def soft_diverse_top_k(rows: DataFrame, by: str, order: list, key: list[str], quota, rare: Column) -> DataFrame:
    """First k of each group, in which repeats of a key wait behind all first ones, unless rare or without a key.

    Two windows do what two passes over a sorted list would: a row is deferred if
    an earlier row has its key.  Rows without a key are spread, not ranked together.
    """
    known = F.lit(True)
    for c in key:
        known = known & F.coalesce(F.col(c) != "", F.lit(False))
    rows = rows.withColumn("_alone", F.monotonically_increasing_id()).withColumn("_alone", F.when(~known, F.col("_alone")))
    nth = F.row_number().over(Window.partitionBy(by, *key, "_alone").orderBy(*order))
    rows = rows.withColumn("deferred", (nth > 1) & known & ~rare).drop("_alone")
    return top_k(rows, [by], [F.col("deferred"), *order], quota)


def hamilton_targets(sizes: DataFrame, total, strata: list[str], size: str = "n", tie: Column | None = None) -> DataFrame:
    """``strata, n, target``: a total shared over strata by their sizes, the largest remainders first."""
    everything = sizes.agg(F.sum(size).alias("_all"), F.lit(None).alias("_x")).drop("_x")
    s = sizes.crossJoin(F.broadcast(everything))  # one row
    want = total if isinstance(total, Column) else F.lit(total)
    share = F.col(size) * want / F.col("_all")
    s = s.withColumns({"_base": F.floor(share), "_frac": share - F.floor(share), "_want": want.cast("long")})
    order = [F.desc("_frac"), tie if tie is not None else F.concat_ws("|", *strata)]
    s = s.withColumns({"_left": F.col("_want") - F.sum("_base").over(Window.partitionBy()), "_r": F.row_number().over(Window.orderBy(*order))})
    target = F.least(F.col(size), F.col("_base") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0))
    return s.select(*strata, size, target.cast("long").alias("target"))


def hamilton_split(rows: DataFrame, strata: list[str], share: float, key: str, salt: str = "") -> DataFrame:
    """``rows`` with ``held_out``: a share of each stratum, by largest remainder and hash order."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    total = F.bround(F.col("_all") * share)
    targets = hamilton_targets(sizes, total, strata).drop("n")
    ranked = rank_within(rows, strata, [stable_rank(key, salt=salt), F.col(key)], "_rank")
    return ranked.join(targets, strata).withColumn("held_out", F.col("_rank") <= F.col("target")).drop("_rank", "target")


def evenly_spaced(rows: DataFrame, by: str, order: list, count: int, truncate: bool = False) -> DataFrame:
    """``count`` rows of each group at even steps, both ends included; one row: the middle one.

    Steps are rounded half to even, or cut down with ``truncate``.
    """
    rows = rank_within(rows, [by], order, "_i", size="_n").withColumn("_i", F.col("_i") - 1)
    if count == 1:
        return rows.where(F.col("_i") == F.floor(F.col("_n") / 2)).drop("_i", "_n")
    step = (F.col("_n") - 1) / F.lit(float(count - 1))
    # the k whose step can land on row i, checked exactly
    k = F.when(step > 0, F.round(F.col("_i") / step)).otherwise(0)
    lands = lambda x: (F.floor(x * step) if truncate else F.bround(x * step))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit = hit | ((lands(k + d) == F.col("_i")) & (k + d >= 0) & (k + d <= count - 1))
    return rows.where((F.col("_n") <= count) | hit).drop("_i", "_n")


def water_fill(capacities: DataFrame, key: str, base: int, total: int, capacity: str = "capacity", order: str = "ord") -> DataFrame:
    """``key, quota``: base for each, cut to its capacity, and what is missing dealt out one by one in rounds.

    The level that whole rounds reach follows from the sums over keys sorted by what
    they can still take; the rest goes to the first keys that are not full.  The windows hold a row a key.
    """
    start = capacities.withColumn("_base", F.least(F.col(capacity), F.lit(base))).withColumn("_spare", F.col(capacity) - F.col("_base"))
    everything = Window.partitionBy()
    missing = F.greatest(F.lit(0), F.lit(total) - F.sum("_base").over(everything))
    up = Window.orderBy("_spare").rowsBetween(Window.unboundedPreceding, 0)
    # what is dealt by the time a key is full
    full = F.sum("_spare").over(up) + (F.count("*").over(everything) - F.count("*").over(up)) * F.col("_spare")
    x = start.withColumns({"_missing": missing, "_full": full}).withColumn("_met", F.col("_full") <= F.col("_missing"))
    x = x.withColumns({"_low": F.coalesce(F.max(F.when(F.col("_met"), F.col("_spare"))).over(everything), F.lit(0)), "_used": F.coalesce(F.max(F.when(F.col("_met"), F.col("_full"))).over(everything), F.lit(0))})
    x = x.withColumn("_open", F.count_if(F.col("_spare") > F.col("_low")).over(everything))
    x = x.withColumn("_rounds", F.coalesce(F.floor(F.try_divide(F.col("_missing") - F.col("_used"), F.col("_open"))), F.lit(0)))
    x = x.withColumns({"_level": F.col("_low") + F.col("_rounds"), "_left": F.col("_missing") - F.col("_used") - F.col("_rounds") * F.col("_open")})
    turn = F.row_number().over(Window.orderBy((F.col("_spare") <= F.col("_level")), order))
    one = F.when((F.col("_spare") > F.col("_level")) & (turn <= F.col("_left")), 1).otherwise(0)
    return x.select(key, (F.col("_base") + F.least("_spare", "_level") + one).cast("long").alias("quota"))


def top_up(rows: DataFrame, chosen: DataFrame, by: str, digest: str, order: list, by_order: str, needed: int) -> DataFrame:
    """Replacements for a short selection: unused contents, round-robin over the groups."""
    free = rows.join(chosen.select(digest), digest, "left_anti")
    first = free.withColumn("_d", F.row_number().over(Window.partitionBy(digest).orderBy(by_order, *order))).where("_d = 1").drop("_d")
    turn = first.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    # no group can give more than all that is needed
    return turn.where(F.col("_k") <= needed).orderBy("_k", by_order).limit(needed).drop("_k")


def replay(rows: DataFrame, strata: list[tuple[str, Column, int | None, int]], order: list) -> DataFrame:
    """Rows repeated by stratum: (name, condition, most rows or None, repeats); the first stratum that fits counts.

    Adds ``stratum`` and ``repeat`` (from 1); rows of no stratum are left out.
    """
    name, most, times = F, F, F
    for n, when, k, r in strata:
        name, most, times = name.when(when, n), most.when(when, F.lit(k if k is not None else 2**62)), times.when(when, r)
    rows = rows.withColumns({"stratum": name.otherwise(None), "_most": most.otherwise(0), "_times": times.otherwise(0)}).where("stratum is not null")
    kept = rank_within(rows, ["stratum"], order, "_r").where("_r <= _most")
    return kept.withColumn("repeat", F.explode(F.sequence(F.lit(1), "_times"))).drop("_r", "_most", "_times")


def group_hold_out(rows: DataFrame, group: str, share: float | None = None, count: int | None = None, salt: str = "42:") -> DataFrame:
    """``rows`` with ``held_out`` for whole groups: the first by hash."""
    groups = rows.select(group).distinct()
    most = count if count is not None else math.floor(groups.count() * share)
    ranked = with_rank(groups, [stable_rank(group, salt=salt), F.col(group)], "_r")
    return rows.join(ranked.select(group, (F.col("_r") <= most).alias("held_out")), group)


def hash_sample(rows: DataFrame, by: list[str], k: int, key: str, salt: str) -> DataFrame:
    """k rows of each stratum in the order of a salted hash: a seeded sample that repeats on any cluster."""
    return top_k(rows, by, [stable_rank(key, salt=salt), F.col(key)], k).drop("rank")


def running_index(rows: DataFrame, by: str, order: list, name: str = "index") -> DataFrame:
    return rank_within(rows, [by], order, name).withColumn(name, F.col(name) - 1)
