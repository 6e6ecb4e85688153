"""Label texts: one parser with a status per line, and policies on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scoring import all_of

EPS = 1e-6
CLASSES = (0, 1)


def parse(labels: DataFrame, classes=CLASSES, eps: float = EPS, float_classes: bool = False) -> DataFrame:
    """One row a line of ``labels`` (stem, text): the box, its corners and a status.

    status, the first that applies: malformed (not five fields), parse_error,
    invalid_class, out_of_range (a value beyond [0, 1] by more than eps, or a size
    below 0), zero_area, outside (a corner beyond the image by more than eps), ok.
    An empty or blank text has no lines.
    """
    texts = labels.select(*labels.columns, F.split(F.regexp_replace(F.col("text"), r"^\s+|\s+$", ""), r"\r?\n").alias("_lines"))
    lines = texts.where("trim(text) <> '' and text rlike '[^ \\t\\r\\n]'").select(*(c for c in labels.columns if c != "text"), F.posexplode("_lines").alias("line", "raw"))
    fields = F.filter(F.split("raw", r"\s+"), lambda x: x != "")
    rows = lines.withColumn("_f", fields)
    number = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    cls = F.when(number(0) == F.floor(number(0)), number(0).cast("int")) if float_classes else F.when(F.get("_f", F.lit(0)).rlike(r"^[+-]?[0-9]+$"), F.get("_f", F.lit(0)).try_cast("int"))
    rows = rows.withColumns({"_n": F.size("_f"), "cls": F.when(F.size("_f") == 5, cls), **{c: F.when(F.size("_f") == 5, number(i)) for i, c in enumerate(("xc", "yc", "w", "h"), 1)}})
    return with_status(rows, classes, eps, malformed=F.col("_n") != 5).drop("_f", "_n")


def with_status(boxes: DataFrame, classes=CLASSES, eps: float = EPS, malformed: Column | None = None) -> DataFrame:
    """``boxes`` (cls, xc, yc, w, h) with corners, area share and status."""
    box = g.corners("xc", "yc", "w", "h")
    boxes = boxes.withColumn("box", box)
    missing = F.col("cls").isNull() | F.col("xc").isNull() | F.col("yc").isNull() | F.col("w").isNull() | F.col("h").isNull()
    within = lambda c, lo: (F.col(c) >= lo - eps) & (F.col(c) <= 1 + eps)
    in_range = all_of(*(within(c, 0) for c in ("xc", "yc", "w", "h")))
    inside = (F.col("box.x1") >= -eps) & (F.col("box.y1") >= -eps) & (F.col("box.x2") <= 1 + eps) & (F.col("box.y2") <= 1 + eps)
    status = F.when(F.lit(False) if malformed is None else malformed, "malformed").when(missing, "parse_error")
    status = status.when(~F.col("cls").isin(*classes), "invalid_class").when(~in_range, "out_of_range").when((F.col("w") <= 0) | (F.col("h") <= 0), "zero_area").when(~inside, "outside").otherwise("ok")
    return boxes.withColumns({"status": status, "share": F.col("w") * F.col("h")})


def usable(parsed: DataFrame, skip=("malformed", "parse_error", "invalid_class", "zero_area")) -> DataFrame:
    """The lines a lenient reader keeps."""
    return parsed.where(~F.col("status").isin(*skip))


def rejected_stems(parsed: DataFrame, bad=("malformed", "parse_error", "invalid_class", "out_of_range", "zero_area", "outside")) -> DataFrame:
    """``stem``: files that a strict reader refuses as a whole."""
    return parsed.groupBy("stem").agg(F.max(F.col("status").isin(*bad)).alias("bad")).where("bad").select("stem")


def raising(parsed: DataFrame, bad=("malformed", "parse_error")) -> DataFrame:
    """The same rows; reading one with a bad status fails the job."""
    told = F.concat(F.lit("bad label line in "), F.col("stem"), F.lit(": "), F.col("status"))
    return parsed.withColumn("status", F.when(F.col("status").isin(*bad), F.raise_error(told).cast("string")).otherwise(F.col("status")))


def issue_log(parsed: DataFrame) -> DataFrame:
    """``stem, line, type, overflow``: every rule a line breaks; a line may break several."""
    bad = parsed.where("status <> 'ok'").select("stem", "line", F.col("status").alias("type"), g.overflow("box").alias("overflow"))
    known = parsed.where("status not in ('malformed', 'parse_error', 'invalid_class')")
    tiny = known.where((F.col("share") > 0) & (F.col("share") < g.TINY_AREA)).select("stem", "line", F.lit("tiny_box").alias("type"), F.lit(0.0).alias("overflow"))
    huge = known.where(F.col("share") > g.HUGE_AREA).select("stem", "line", F.lit("huge_box").alias("type"), F.lit(0.0).alias("overflow"))
    return bad.unionByName(tiny).unionByName(huge)


CRITICAL = ("malformed", "parse_error", "invalid_class", "out_of_range", "zero_area")


def verdict(issues: DataFrame, critical=CRITICAL) -> DataFrame:
    """One row: critical issues, warnings, and STRUCTURAL_PASS where none is critical."""
    is_critical = F.col("type").isin(*critical)
    counts = issues.agg(F.count_if(is_critical).alias("critical"), F.count_if(~is_critical).alias("warnings"))
    return counts.withColumn("verdict", F.when(F.col("critical") == 0, "STRUCTURAL_PASS").otherwise("STRUCTURAL_FAIL"))


def sanitize(boxes: DataFrame, eps: float = 1e-12, protected: Column | None = None) -> DataFrame:
    """``boxes`` with action and the box that stays.

    keep; drop_zero_area; clip_boundary (cut to the image); drop_after_clip (nothing
    left).  Rows for which ``protected`` holds are kept as they are.
    """
    rows = with_status(boxes, eps=eps) if "box" not in boxes.columns else boxes
    rows = rows.withColumn("cut", g.clipped("box"))
    over = g.overflow("box") > eps
    gone = (F.col("cut.x2") <= F.col("cut.x1")) | (F.col("cut.y2") <= F.col("cut.y1"))
    action = F.when((F.col("w") <= 0) | (F.col("h") <= 0), "drop_zero_area").when(over & gone, "drop_after_clip").when(over, "clip_boundary").otherwise("keep")
    rows = rows.withColumn("action", action if protected is None else F.when(protected, "keep").otherwise(action))
    as_given = F.struct("xc", "yc", "w", "h")
    stays = F.when(F.col("action") == "clip_boundary", g.centre("cut")).when(F.col("action") == "keep", as_given)
    return rows.withColumn("after", stays).drop("cut")


def change_log(sanitized: DataFrame) -> DataFrame:
    """``stem, split, line, action, before, after`` of the lines that changed."""
    before = g.label_line("cls", F.struct("xc", "yc", "w", "h"))
    after = F.when(F.col("after").isNotNull(), g.label_line("cls", "after")).otherwise("")
    return sanitized.where("action <> 'keep'").select("stem", "split", "line", "action", before.alias("before"), after.alias("after"))


def byte_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """``stem, state``: same, changed, or missing on a side, of two label tables (stem, text)."""
    x, y = (d.select("stem", F.sha2("text", 256).alias(c)) for d, c in ((a, "ha"), (b, "hb")))
    state = F.when(F.col("hb").isNull(), "missing_b").when(F.col("ha").isNull(), "missing_a").when(F.col("ha") == F.col("hb"), "same").otherwise("changed")
    return x.join(y, "stem", "full").select("stem", state.alias("state"))


def pairing(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """``key, state``: paired, or which side is missing."""
    a, b = images.select(key).distinct().withColumn("_a", F.lit(1)), labels.select(key).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_b").isNull(), "missing_label").when(F.col("_a").isNull(), "missing_image").otherwise("paired")
    return a.join(b, key, "full").select(key, state.alias("state"))


def inventory(boxes: DataFrame, key: str = "stem") -> DataFrame:
    """One row an image: category, class x size counts, presence flags and pair intersections."""
    sized = boxes.withColumn("_size", g.size_bucket("share"))
    names = {0: "fire", 1: "smoke"}
    counts = [F.count_if((F.col("cls") == c) & (F.col("_size") == s)).alias(f"{n}_{s}") for c, n in names.items() for s in ("small", "medium", "large")]
    totals = [F.count_if(F.col("cls") == c).alias(f"{n}_total") for c, n in names.items()]
    rows = sized.groupBy(key).agg(F.count("*").alias("box_count"), *totals, *counts)
    from ..functions.scoring import category

    flags = {f"has_{s}_{n}": (F.col(f"{n}_{s}") > 0).cast("int") for n in names.values() for s in ("small", "medium", "large")}
    rows = rows.withColumn("category", category(F.col("fire_total") > 0, F.col("smoke_total") > 0)).withColumns(flags)
    return rows.withColumn("has_fire_smoke", ((F.col("fire_total") > 0) & (F.col("smoke_total") > 0)).cast("int"))


def empty_labels(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose label text holds nothing but white space: images without objects."""
    return texts.where(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) == "")


def with_hashes(rows: DataFrame, hashes: DataFrame, columns=("phash", "dhash"), key: str = "stem") -> DataFrame:
    """Inventory rows with their hashes; an image without any has empty ones."""
    joined = rows.join(hashes.select(key, *columns), key, "left")
    return joined.fillna("", list(columns))


def large_boxes(boxes: DataFrame, least: float = g.HUGE_AREA, digits: int = 4) -> DataFrame:
    """Boxes whose area share is above a bound, with half-even rounding."""
    return boxes.where(F.col("share") > least).withColumn("share_rounded", F.bround("share", digits))
