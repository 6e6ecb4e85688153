"""Exact duplicates: groups, comparison of their annotations, and what stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import relation, split_rank

SAFE = ("exact_annotation", "equivalent_annotation")


def hash_groups(items: DataFrame, key: str, content: str, size: str | None = None, split: str = "split") -> DataFrame:
    """Groups of equal content: ``digest, n, first, splits, signature``; ``first`` is the smallest key.

    With a ``size`` column only items whose size repeats are hashed at all.  A
    group is counted, never gathered; ``group_members`` lists its rows.
    """
    rows = items
    if size:
        repeated = items.groupBy(size).agg(F.count("*").alias("_n")).where("_n > 1").select(size)
        rows = items.join(repeated, size, "left_semi")
    rows = rows.withColumn("digest", F.sha2(content, 256))
    grouped = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.array_sort(F.collect_set(split)).alias("splits"))
    return grouped.where("n > 1").withColumn("signature", F.array_join("splits", "+"))


def group_members(items: DataFrame, groups: DataFrame, key: str, content: str, split: str = "split") -> DataFrame:
    """``digest, key, split`` of every member of the groups."""
    rows = items.select(F.sha2(content, 256).alias("digest"), key, split)
    return rows.join(groups.select("digest"), "digest", "left_semi")


def numbered(groups: DataFrame) -> DataFrame:
    """Groups numbered from 1, the largest first, then by their first member.

    The order is global: Spark sorts by range and then counts on within it.
    """
    return with_rank(groups, [F.desc("n"), F.col("first")], "group_id")


def with_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """A gapless number from 1 in a global order, without putting all rows in one task.

    Rows are range-partitioned by the order; each partition is counted, and its
    rows are numbered on from what lies before it.
    """
    from ..plans.storage import stored

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a partition
    placed = ranged.join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_before")


def rank_within(df: DataFrame, by: list[str], order: list, name: str, size: str | None = None) -> DataFrame:
    """A gapless number from 1 within each group, and the group's size if asked for.

    The groups are ranked in one global order, so that a group with most of the
    rows is spread over tasks as any other rows are.
    """
    ranked = with_rank(df, [*map(F.col, by), *order], "_g")
    groups = ranked.groupBy(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by))).agg(F.min("_g").alias("_first"), F.count("*").alias("_size"))
    match = F.lit(True)
    for i, c in enumerate(by):
        match = match & ranked[c].eqNullSafe(groups[f"_by_{i}"])
    out = ranked.join(groups, match).withColumn(name, F.col("_g") - F.col("_first") + 1)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_g", "_first", "_size", *(f"_by_{i}" for i in range(len(by))))


def leakage_flags(groups: DataFrame, splits: str = "splits") -> DataFrame:
    """Which pairs of splits a group joins."""
    has = lambda *s: F.array_contains(splits, s[0]) & F.array_contains(splits, s[1])
    return groups.withColumns({"train_test": has("train", "test"), "train_val": has("train", "val"), "val_test": has("val", "test"), "cross_split": F.size(splits) > 1})


def member_pairs(items: DataFrame, group: str, key: str, columns: list[str]) -> DataFrame:
    """All unordered pairs within each group, the smaller key first, columns suffixed _a and _b.

    Meant for groups that need a verdict per pair; its rows grow with the square
    of a group.
    """
    side = lambda x: items.select(F.col(group), *(F.col(c).alias(f"{c}_{x}") for c in [key, *columns]))
    return side("a").join(side("b"), group).where(F.col(f"{key}_a") < F.col(f"{key}_b"))


def compare_annotations(a: Column, b: Column, text_a: Column | None = None, text_b: Column | None = None, tolerance: float = 1e-9) -> Column:
    """How two box arrays (struct cls, xc, yc, w, h) differ; null means no label.

    In this order: missing_label, exact_annotation, equivalent_annotation (equal
    within the tolerance), box_count_conflict, class_conflict, geometry_conflict.
    """
    sa, sb = F.array_sort(a), F.array_sort(b)
    classes = lambda x: F.array_sort(F.transform(x, lambda q: q["cls"]))
    near = F.forall(F.zip_with(sa, sb, lambda x, y: _close(x, y, tolerance)), lambda ok: ok)
    same_text = (text_a == text_b) if text_a is not None else (a == b)
    return (
        F.when(a.isNull() | b.isNull(), "missing_label").when(same_text, "exact_annotation").when((F.size(a) == F.size(b)) & near, "equivalent_annotation")
        .when(F.size(a) != F.size(b), "box_count_conflict").when(classes(a) != classes(b), "class_conflict").otherwise("geometry_conflict")
    )


def _close(x: Column, y: Column, tolerance: float) -> Column:
    far = [F.abs(x[c] - y[c]) > tolerance for c in ("xc", "yc", "w", "h")]
    return F.coalesce((x["cls"] == y["cls"]) & ~(far[0] | far[1] | far[2] | far[3]), F.lit(False))


def decide(pairs: DataFrame, key: str = "stem", safe=SAFE) -> DataFrame:
    """One row a decision ``relation, result, action, role, key, split`` per pair and member concerned.

    Safe pairs: in one split the smaller key stays; across splits the higher split
    stays.  Conflicts: in one split both are quarantined; across splits the lower
    is excluded and the higher quarantined.  A missing label is no safe pair.
    """
    a, b = (F.struct(F.col(f"{key}_{x}").alias("key"), F.col(f"split_{x}").alias("split")) for x in "ab")
    rows = pairs.withColumns({"relation": relation("split_a", "split_b"), "_same": F.col("split_a") == F.col("split_b")})
    a_wins = F.when(F.col("_same"), F.col(f"{key}_a") < F.col(f"{key}_b")).otherwise(split_rank("split_a") > split_rank("split_b"))
    high, low = F.when(a_wins, a).otherwise(b), F.when(a_wins, b).otherwise(a)
    ok = F.col("result").isin(*safe)
    role = lambda name, member: F.struct(F.lit(name).alias("role"), member["key"].alias("key"), member["split"].alias("split"))
    action = F.when(ok & F.col("_same"), "safe_same_split_keep_lexical_canonical").when(ok, "safe_cross_split_keep_higher_priority").when(F.col("_same"), "conflict_same_split_quarantine_both").otherwise("conflict_cross_split_exclude_lower_quarantine_higher")
    roles = F.when(ok, F.array(role("keep", high), role("exclude", low))).when(F.col("_same"), F.array(role("quarantine", a), role("quarantine", b))).otherwise(F.array(role("exclude", low), role("quarantine", high)))
    keep = [c for c in ("group_id", "result") if c in pairs.columns]
    return rows.select(*keep, "relation", action.alias("action"), F.explode(roles).alias("r")).select(*keep, "relation", "action", "r.role", F.col("r.key").alias(key), F.col("r.split").alias("split"))


def removals(decisions: DataFrame, key: str = "stem") -> DataFrame:
    """``key, split, role``: what leaves the clean layer; quarantine outranks exclusion."""
    out = decisions.where("role <> 'keep'").groupBy(key, "split").agg(F.max("role").alias("role"))
    return out


def _class_pairs(items: DataFrame, group: str, key: str, split: str, boxes: str, safe=SAFE) -> tuple[DataFrame, DataFrame]:
    """Members by class (group, split and annotation), and the ordered pairs of classes of a group, a class with itself included.

    How two members compare follows from their classes, so copies are counted and
    never paired: the work grows with the members and with the kinds of
    annotation in a group.
    """
    classes = items.groupBy(group, split, boxes).agg(F.count("*").alias("n"), F.min(key).alias("lo"))
    side = lambda x: classes.select(group, *(F.col(c).alias(f"{c}_{x}") for c in (split, boxes, "n", "lo")))
    pairs = side("a").join(side("b"), group)
    one = F.col("lo_a") == F.col("lo_b")  # the smallest key tells classes apart
    pairs = pairs.where(~one | (F.col("n_a") > 1)).withColumn("_one", one)
    return classes, pairs.withColumn("result", compare_annotations(F.col(f"{boxes}_a"), F.col(f"{boxes}_b"))).withColumn("_safe", F.col("result").isin(*safe))


def relation_matrix(items: DataFrame, group: str, key: str, split: str = "split", boxes: str = "boxes") -> DataFrame:
    """``relation, result, n``: how many pairs of members of a group there are of each kind."""
    _, pairs = _class_pairs(items, group, key, split, boxes)
    n = F.when(F.col("_one"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    once = pairs.where(F.col("lo_a") <= F.col("lo_b"))
    return once.groupBy(relation(f"{split}_a", f"{split}_b").alias("relation"), "result").agg(F.sum(n.cast("long")).alias("n"))


def member_removals(items: DataFrame, group: str, key: str, split: str = "split", boxes: str = "boxes", safe=SAFE) -> DataFrame:
    """``removals(decide(pairs))`` without the pairs: ``key, split, role`` of the members that leave the clean layer."""
    _, pairs = _class_pairs(items, group, key, split, boxes, safe)
    same = F.col(f"{split}_a") == F.col(f"{split}_b")
    lower = split_rank(f"{split}_a") < split_rank(f"{split}_b")
    told = pairs.groupBy(group, F.col(f"{split}_a").alias(split), F.col("lo_a").alias("_lo")).agg(
        F.bool_or(~F.col("_safe") & (same | ~lower)).alias("_held"), F.bool_or(~same & lower).alias("_out"), F.min(F.when(same & F.col("_safe"), F.col("lo_b"))).alias("_first"),
    )
    own = items.groupBy(F.col(group).alias("_g"), F.col(split).alias("_s"), F.col(boxes).alias("_b")).agg(F.min(key).alias("_lo"))
    match = (F.col(group) == F.col("_g")) & (F.col(split) == F.col("_s")) & F.col(boxes).eqNullSafe(F.col("_b"))
    members = items.join(own, match).select(group, key, split, "_lo").join(told, [group, split, "_lo"])
    role = F.when(F.col("_held"), "quarantine").when(F.col("_out") | (F.col(key) > F.col("_first")), "exclude")
    return members.select(key, split, role.alias("role")).where("role is not null")


def first_per_hash(items: DataFrame, digest: str, order: list) -> DataFrame:
    """The first item of each content in the given order."""
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(digest).orderBy(*order))).where("_r = 1").drop("_r")
