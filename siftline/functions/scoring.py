"""Categories, tiers, scores and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col

# Thresholds and weights that results depend on.
PRIORITY = {"train": 0, "val": 1, "test": 2}
GATES = {
    "ultra_strict": {"corr": 0.999, "mae": 0.010, "color": 0.995},
    "very_strict": {"corr": 0.995, "mae": 0.020, "color": 0.990},
    "strict": {"corr": 0.990, "mae": 0.030, "color": 0.980},
}
SEVERITIES = {"EXTREME": 0.75, "HARD": 0.50, "MODERATE": 0.25, "LOW": 0.10}
MODEL_WEIGHTS = {"n": 0.31, "s": 0.33, "m": 0.36}


def ratio(a, b) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def all_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def split_rank(split) -> Column:
    s = col(split)
    return F.when(s == "train", 0).when(s == "val", 1).when(s == "test", 2)


def relation(a, b) -> Column:
    """Name of a pair of splits, the lower rank first."""
    a, b = col(a), col(b)
    low, high = (F.when(split_rank(a) <= split_rank(b), x).otherwise(y) for x, y in ((a, b), (b, a)))
    return F.when(a == b, F.concat(F.lit("same_"), a)).otherwise(F.concat_ws("_", low, high))


def category(has_first, has_second) -> Column:
    a, b = col(has_first), col(has_second)
    return F.when(a & b, "fire_smoke").when(a, "fire_only").when(b, "smoke_only").otherwise("negative")


def semantic_category(stem) -> Column:
    s = F.lower(col(stem))
    rules = [("bothfireandsmoke", "fire_smoke"), ("fire", "fire_only"), ("smoke", "smoke_only")]
    out = F
    for prefix, name in rules:
        out = out.when(s.startswith(prefix), name)
    negative = s.contains("neither") | s.contains("negative") | s.contains("nofire")
    return out.when(negative, "negative").otherwise("other")


def category_group(cat) -> Column:
    c = col(cat)
    return F.when(c.isin("fire_only", "smoke_only"), c).otherwise("stable")


def split_of_name(stem) -> Column:
    """The second of at least three parts of a name, joined by underscores."""
    parts = F.split(col(stem), "_", 3)
    return F.when(F.size(parts) >= 3, parts[1]).otherwise("unknown")


def filename_sequence(a, b, close: int = 5) -> Column:
    """struct(same_prefix, index_gap, close_index) of two names that end in numbers."""
    part = lambda c, i: F.regexp_extract(col(c), r"(?s)^(.*?)([0-9]+)$", i)
    number = lambda c: part(c, 2).try_cast("bigint")
    same = (part(a, 2) != "") & (part(b, 2) != "") & (part(a, 1) == part(b, 1))
    gap = F.when(same, F.abs(number(a) - number(b)))
    return F.struct(same.alias("same_prefix"), gap.alias("index_gap"), F.coalesce(gap <= close, F.lit(False)).alias("close_index"))


def hash_bits(hex_digits) -> Column:
    """16 hexadecimal digits as a signed 64-bit integer; null or empty: null."""
    h = col(hex_digits)
    return F.when(F.length(h) > 0, F.conv(h, 16, -10).cast("bigint"))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def dual_hash_gate(p, d, aspect, primary: int = 10, secondary: int = 20, widest: float = 0.08) -> Column:
    """One hash is close, neither is far, and the shapes agree."""
    p, d = col(p), col(d)
    return ((p <= primary) | (d <= primary)) & (p <= secondary) & (d <= secondary) & (col(aspect) <= widest)


def passed_gates(corr, mae, color, gates=GATES) -> Column:
    """Array of the gates that a pair's metrics pass, strictest first."""
    ok = lambda g: all_of(col(corr) >= g["corr"], col(mae) <= g["mae"], col(color) >= g["color"])
    return F.array_compact(F.array(*(F.when(ok(g), name) for name, g in gates.items())))


def image_tier(corr, mae, psnr, color) -> Column:
    corr, mae, psnr, color = map(col, (corr, mae, psnr, color))
    extreme = all_of(corr >= 0.9995, mae <= 0.005, psnr >= 40.0, color >= 0.999)
    ultra = all_of(corr >= 0.999, mae <= 0.010, color >= 0.995)
    return F.when(extreme, "EXTREME").when(ultra, "ULTRA").otherwise("OTHER")


def annotation_state(same, same_classes, same_count, m30, m50) -> Column:
    """From equality and the matches (coverage_a, coverage_b, mean_iou) at IoU .3 and .5."""
    m30, m50 = col(m30), col(m50)
    reaches = lambda m, cover, mean: all_of(m["coverage_a"] >= cover, m["coverage_b"] >= cover, m["mean_iou"] >= mean)
    return F.when(col(same), "EXACT").when(col(same_classes) & col(same_count) & reaches(m50, 0.80, 0.70), "STRONG").when(col(same_classes) & reaches(m30, 0.70, 0.50), "MODERATE").otherwise("CONFLICT")


def leakage_priority(tier, state) -> Column:
    t, s = col(tier), col(state)
    sure = s.isin("EXACT", "STRONG")
    return F.when(t == "EXTREME", F.when(sure, "VERY_HIGH").otherwise("HIGH")).when((t == "ULTRA") & sure, "HIGH").when((t == "ULTRA") & (s == "MODERATE"), "MEDIUM").otherwise("REVIEW")


def component_type(splits) -> Column:
    """Name of the set of splits a component spans."""
    s = F.array_distinct(col(splits))
    ordered = F.filter(F.array(*(F.when(F.array_contains(s, x), x) for x in PRIORITY)), lambda x: x.isNotNull())
    return F.when(F.size(ordered) == 1, F.concat(F.lit("same_"), ordered[0])).otherwise(F.array_join(ordered, "_"))


def stable_rank(*columns, salt: str = "") -> Column:
    """SHA-256 of a salt and columns: an order that looks random and repeats."""
    return F.sha2(F.concat(F.lit(salt), *(col(c).cast("string") for c in columns)), 256)


def severity(conf) -> Column:
    out = F
    for name, least in SEVERITIES.items():
        out = out.when(col(conf) >= least, name)
    return out.otherwise("NONE")


def votes(confs, least: float) -> Column:
    return F.size(F.filter(col(confs), lambda c: c >= least))


def ensemble_severity(confs) -> Column:
    """Severity by how many models alert, and how strongly."""
    some, strong, any_ = votes(confs, 0.25), votes(confs, 0.50), votes(confs, 0.10)
    top = F.array_max(col(confs))
    return F.when((some == 3) | (strong >= 2), "EXTREME").when((some >= 2) | (top >= 0.75), "HARD").when((some == 1) | (any_ >= 1), "MODERATE").otherwise("EASY")


def mean_of(values) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda a, x: a + x) / F.size(col(values))


def hardness(confs) -> Column:
    return 0.30 * mean_of(confs) + 0.25 * (votes(confs, 0.25) / 3) + 0.25 * (votes(confs, 0.50) / 3) + 0.20 * F.array_max(col(confs))


def selection_score(cat, n) -> Column:
    """Rank score of an inventory row: rare small objects first, per category.

    ``n(name)`` gives a count column: fire_small .. smoke_large, fire_total, smoke_total, box_count.
    """
    has = lambda name, points: F.when(n(name) > 0, points).otherwise(0)
    capped = lambda name, most: F.least(n(name), F.lit(most))
    fire = has("fire_small", 150) + has("fire_medium", 70) + has("fire_large", 10) + capped("fire_total", 10)
    smoke = has("smoke_small", 5000) + has("smoke_medium", 150) + has("smoke_large", 10) + capped("smoke_total", 10)
    both = has("smoke_small", 5000) + has("fire_small", 200) + has("smoke_medium", 140) + has("fire_medium", 70) + has("fire_large", 15) + has("smoke_large", 5) + capped("box_count", 15)
    c = col(cat)
    return F.when(c == "fire_only", fire).when(c == "smoke_only", smoke).when(c == "fire_smoke", both).when(c == "negative", 0)


def fbeta(precision, recall, beta: float = 2.0) -> Column:
    p, r = col(precision), col(recall)
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def confusion_ratios(tp, fp, tn, fn, beta: float = 2.0) -> list[Column]:
    """precision, recall, specificity, accuracy and F-beta; 0 where undefined."""
    tp, fp, tn, fn = map(col, (tp, fp, tn, fn))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), fbeta(p, r, beta).alias("f_beta")]


def risk_score(missing, unsupported, conflicts, singletons, cat) -> Column:
    m = col(missing)
    single = F.when(col(cat).isin("fire_only", "smoke_only") & (m > 0), 0.75).otherwise(0.0)
    return m * 2.5 + col(unsupported) * 1.5 + col(conflicts) * 2.5 + F.least(col(singletons) * 0.5, F.lit(2.0)) + single


REASONS = {"missing_fire": "missing_fire", "missing_smoke": "missing_smoke", "class_conflicts": "class_conflict", "unsupported_gt": "unsupported_gt", "strong_singletons": "strong_singleton"}


def reason(fallback: str = "risk_prior") -> Column:
    """Pipe-joined flags of the counts that aren't zero."""
    flags = F.array_compact(F.array(*(F.when(F.col(c) > 0, name) for c, name in REASONS.items())))
    return F.when(F.size(flags) == 0, fallback).otherwise(F.array_join(flags, "|"))


def annotation_score(gt_coverage, consensus_coverage, mean_iou) -> Column:
    return 0.45 * col(gt_coverage) + 0.35 * col(consensus_coverage) + 0.20 * col(mean_iou)


def adjudicate(rel, conflict, a, b, consensus, strong: float = 0.60, margin: float = 0.15, reasonable: float = 0.60, close: float = 0.10) -> Column:
    """Decision between two annotations of one image, test and class conflicts first."""
    a, b = col(a), col(b)
    return (
        F.when(col(rel).contains("test"), "BENCHMARK_QUARANTINE").when(col(conflict) == "class_conflict", "CLASS_CONFLICT_REVIEW").when(col(consensus) == 0, "TEACHER_UNCERTAIN")
        .when((a >= strong) & (a - b >= margin), "A_STRONG").when((b >= strong) & (b - a >= margin), "B_STRONG")
        .when((a >= reasonable) & (b >= reasonable) & (F.abs(a - b) <= close), "BOTH_REASONABLE").otherwise("TEACHER_UNCERTAIN")
    )


def recovery_eligible(rel, decision) -> Column:
    return (col(rel) == "same_train") & col(decision).isin("A_STRONG", "B_STRONG")


def class_profile(counts) -> Column:
    """A map of counts as ``k:v;k:v`` in the order of its keys."""
    entries = F.array_sort(F.map_entries(col(counts)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";")


def epoch_number(name, none: int = 1_000_000_000) -> Column:
    return F.coalesce(F.regexp_extract(col(name), r"epoch([0-9]+)\.pt$", 1).try_cast("bigint"), F.lit(none))


def threshold_tag(t) -> Column:
    """0.25 as 025, for column names."""
    return F.regexp_replace(F.format_string("%.2f", col(t)), "[.]", "")


def safe_double(text) -> Column:
    return F.coalesce(col(text).cast("string").try_cast("double"), F.lit(0.0))


def path_stem(path) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def path_extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./\\]*)$", 1))


def path_key(path, root: str = "/") -> Column:
    """An absolute path with forward slashes, without ``.`` and empty parts; ``..`` takes back the part before it."""
    plain = F.regexp_replace(col(path), r"\\", "/")
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), plain))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def iso_time(time) -> Column:
    """A timestamp as ISO text to the second, in the session's time zone."""
    return F.date_format(col(time), "yyyy-MM-dd'T'HH:mm:ss")


def parent_path(path) -> Column:
    return F.regexp_extract(col(path), r"^(.*)[/\\][^/\\]*$", 1)
