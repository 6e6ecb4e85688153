"""Label parsing, audit, sanitizing and inventory of boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import labels as lab
from ..operators import manifest
from ..sources.sinks import label_files
from .base import SQL_BOX, boxes, query

_B = f"with {SQL_BOX}"
_SIZE = "case when share < 0.005 then 'small' when share < 0.05 then 'medium' else 'large' end"
_STATUS = "case when xc < -1e-6 or xc > 1+1e-6 or yc < -1e-6 or yc > 1+1e-6 or w < -1e-6 or w > 1+1e-6 or h < -1e-6 or h > 1+1e-6 then 'out_of_range' when w <= 0 or h <= 0 then 'zero_area' when x1 < -1e-6 or y1 < -1e-6 or x2 > 1+1e-6 or y2 > 1+1e-6 then 'outside' else 'ok' end"


@query("box_size_profile", f"{_B} select cls, {_SIZE} as size, count(*) as n, round(sum(share), 6) as area from box where share > 0 group by 1, 2")
def box_size_profile(spark, sf_dir):
    b = boxes(spark, sf_dir, numbered=False).where("share > 0")
    return b.groupBy("cls", g.size_bucket("share").alias("size")).agg(F.count("*").alias("n"), F.round(F.sum("share"), 6).alias("area"))


def _status(spark, sf_dir):
    return lab.with_status(boxes(spark, sf_dir, numbered=False))


@query("box_audit_status", f"{_B} select {_STATUS} as status, count(*) as n from box group by 1")
def box_audit_status(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


_OVER = "greatest(0, -x1, -y1, x2-1, y2-1)"
_ISSUES = f"""{_B}, st as (select *, {_STATUS} as status from box), issue as (select bid, img, status as type, {_OVER} as overflow from st where status <> 'ok' union all select bid, img, 'tiny_box', 0.0 from st where share > 0 and share < 0.00005 union all select bid, img, 'huge_box', 0.0 from st where share > 0.80)"""


def _issues(spark, sf_dir, numbered=True):
    b = boxes(spark, sf_dir, numbered)
    return lab.issue_log(lab.with_status(b).withColumn("stem", F.col("img")).withColumn("line", F.col("bid") if numbered else F.lit(0)))


@query("box_issue_log", f"{_ISSUES} select bid, img, type, round(overflow, 8) as overflow from issue")
def box_issue_log(spark, sf_dir):
    return _issues(spark, sf_dir).select(F.col("line").alias("bid"), F.col("stem").alias("img"), "type", F.round("overflow", 8).alias("overflow"))


@query("integrity_verdict", f"{_ISSUES}, c as (select count(*) filter (where type in ('malformed','parse_error','invalid_class','out_of_range','zero_area')) as critical, count(*) filter (where type not in ('malformed','parse_error','invalid_class','out_of_range','zero_area')) as warnings from issue) select *, case when critical = 0 then 'STRUCTURAL_PASS' else 'STRUCTURAL_FAIL' end as verdict from c")
def integrity_verdict(spark, sf_dir):
    return lab.verdict(_issues(spark, sf_dir, numbered=False))


_CLIP = f"""{_B}, c as (select *, greatest(0,least(1,x1)) as cx1, greatest(0,least(1,y1)) as cy1, greatest(0,least(1,x2)) as cx2, greatest(0,least(1,y2)) as cy2, {_OVER} as over from box),
    z as (select *, case when w <= 0 or h <= 0 then 'drop_zero_area' when over > 1e-12 and (cx2 <= cx1 or cy2 <= cy1) then 'drop_after_clip' when over > 1e-12 then 'clip_boundary' else 'keep' end as action from c)"""


def _sanitized(spark, sf_dir):
    return lab.sanitize(lab.with_status(boxes(spark, sf_dir)))


@query("box_sanitize", f"""{_CLIP} select bid, action, round(case action when 'clip_boundary' then (cx1+cx2)/2 when 'keep' then xc end, 8) as xc, round(case action when 'clip_boundary' then (cy1+cy2)/2 when 'keep' then yc end, 8) as yc, round(case action when 'clip_boundary' then cx2-cx1 when 'keep' then w end, 8) as w, round(case action when 'clip_boundary' then cy2-cy1 when 'keep' then h end, 8) as h from z""")
def box_sanitize(spark, sf_dir):
    return _sanitized(spark, sf_dir).select("bid", "action", *(F.round(f"after.{c}", 8).alias(c) for c in ("xc", "yc", "w", "h")))


@query("sanitize_change_counts", f"{_CLIP} select action, side, count(*) as n from z where action <> 'keep' group by 1, 2")
def sanitize_change_counts(spark, sf_dir):
    log = lab.change_log(_sanitized(spark, sf_dir).withColumnsRenamed({"img": "stem", "side": "split", "bid": "line"}))
    return log.groupBy("action", F.col("split").alias("side")).agg(F.count("*").alias("n"))


@query("box_large_audit", f"{_B} select bid, cls, round_even(share, 4) as share_rounded from box where share > 0.6")
def box_large_audit(spark, sf_dir):
    # the tables have no box above the usual bound
    return lab.large_boxes(boxes(spark, sf_dir), 0.6).select("bid", "cls", "share_rounded")


_TEXTS = f"""{_B}, line as (select img, bid, case when bid % 97 = 0 then 'bad line' when bid % 89 = 0 then '1.0 0.5 0.5 0.1 0.1' when bid % 83 = 0 then '7 0.5 0.5 0.1 0.1' when bid % 79 = 0 then '0 x 0.5 0.1 0.1' else printf('%d %.6f %.6f %.6f %.6f', cls, xc, yc, w, h) end as t from box),
    lt as (select img, string_agg(t, chr(10) order by bid) as text from line group by img)"""


def label_text(spark, sf_dir):
    """Label texts of every image, with some bad lines among them."""
    b = boxes(spark, sf_dir)
    k = F.col("bid")
    t = F.when(k % 97 == 0, "bad line").when(k % 89 == 0, "1.0 0.5 0.5 0.1 0.1").when(k % 83 == 0, "7 0.5 0.5 0.1 0.1").when(k % 79 == 0, "0 x 0.5 0.1 0.1").otherwise(F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "xc", "yc", "w", "h"))
    lines = b.groupBy(F.col("img").alias("stem")).agg(F.array_sort(F.collect_list(F.struct("bid", t.alias("t")))).alias("l"))
    return lines.select("stem", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


_PARSED = f"""{_TEXTS}, raw as (select img, unnest(string_split(text, chr(10))) as l from lt), f as (select img, string_split(l, ' ') as f from raw),
    n as (select img, len(f) as k, case when regexp_full_match(f[1], '[+-]?[0-9]+') then try_cast(f[1] as int) end as cls, try_cast(f[2] as double) as xc, try_cast(f[3] as double) as yc, try_cast(f[4] as double) as w, try_cast(f[5] as double) as h from f),
    q as (select *, xc-w/2 as x1, yc-h/2 as y1, xc+w/2 as x2, yc+h/2 as y2 from n), p as (select *, case when k <> 5 then 'malformed' when cls is null or xc is null or yc is null or w is null or h is null then 'parse_error' when cls not in (0,1) then 'invalid_class' else {_STATUS} end as status from q)"""


@query("label_parse_status", f"{_PARSED} select status, count(*) as n, count(distinct img) as images from p group by 1")
def label_parse_status(spark, sf_dir):
    return lab.parse(label_text(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("stem").alias("images"))


@query("label_rejected_files", f"{_PARSED} select count(distinct img) as files, count(distinct img) filter (where status <> 'ok') as rejected from p")
def label_rejected_files(spark, sf_dir):
    p = lab.parse(label_text(spark, sf_dir))
    bad = lab.rejected_stems(p).agg(F.count("*").alias("rejected"))
    return p.agg(F.count_distinct("stem").alias("files")).crossJoin(F.broadcast(bad))


@query("label_rewrite", f"""{_B}, ok as (select *, {_STATUS} as status from box), k as (select img, bid, printf('%d %.10f %.10f %.10f %.10f', cls, xc, yc, w, h) as t from ok where status = 'ok'), i as (select distinct img from box),
    r as (select i.img, coalesce(string_agg(t, chr(10) order by bid), '') as text from i left join k on k.img = i.img group by i.img) select img, sha256(text) as digest, length(text) as n from r""")  # fmt: skip
def label_rewrite(spark, sf_dir):
    b = lab.with_status(boxes(spark, sf_dir)).withColumnsRenamed({"img": "stem", "bid": "line"})
    out = label_files(b.where("status = 'ok'"), b.select("stem").distinct())
    return out.select(F.col("stem").alias("img"), F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))


_COUNTS = ", ".join(f"count(*) filter (where cls={c} and {_SIZE}='{z}') as {n}_{z}" for c, n in ((0, "fire"), (1, "smoke")) for z in ("small", "medium", "large"))
_INV = f"""{_B}, inv as (select img, count(*) as box_count, count(*) filter (where cls=0) as fire_total, count(*) filter (where cls=1) as smoke_total, {_COUNTS} from box where share > 0 group by img),
    cat as (select *, case when fire_total > 0 and smoke_total > 0 then 'fire_smoke' when fire_total > 0 then 'fire_only' when smoke_total > 0 then 'smoke_only' else 'negative' end as category from inv)"""


def _inventory(spark, sf_dir):
    return lab.inventory(boxes(spark, sf_dir, numbered=False).where("share > 0"), "img")


@query("image_inventory", f"{_INV} select * from cat")
def image_inventory(spark, sf_dir):
    i = _inventory(spark, sf_dir)
    return i.select([c for c in i.columns if not c.startswith("has_")])


@query("signal_intersections", f"{_INV} select category, count(*) as images, count(*) filter (where fire_small>0 and smoke_small>0) as small_both, count(*) filter (where fire_large>0 and smoke_small>0) as large_small, cast(sum(cast(fire_medium>0 as int)) as bigint) as medium_fire from cat group by 1")
def signal_intersections(spark, sf_dir):
    i = _inventory(spark, sf_dir)
    both = lambda a, b: F.count_if((F.col(a) == 1) & (F.col(b) == 1))
    return i.groupBy("category").agg(F.count("*").alias("images"), both("has_small_fire", "has_small_smoke").alias("small_both"), both("has_large_fire", "has_small_smoke").alias("large_small"), F.sum("has_medium_fire").alias("medium_fire"))


@query("split_profile", f"{_INV} select case when img%10 < 6 then 'train' when img%10 < 8 then 'val' else 'test' end as split, count(*) as images, cast(sum(box_count) as bigint) as boxes, {', '.join(f'''count(*) filter (where category='{c}') as n_{c}''' for c in ('fire_only', 'smoke_only', 'fire_smoke', 'negative'))}, cast(sum(fire_total) as bigint) as fire, cast(sum(smoke_total) as bigint) as smoke from cat group by 1")
def split_profile(spark, sf_dir):
    i = _inventory(spark, sf_dir).withColumn("split", F.expr("case when img % 10 < 6 then 'train' when img % 10 < 8 then 'val' else 'test' end"))
    return manifest.split_profile(i)


@query("selection_scores", f"""{_INV}, z as (select img, category, case category when 'fire_only' then 150*cast(fire_small>0 as int)+70*cast(fire_medium>0 as int)+10*cast(fire_large>0 as int)+least(fire_total,10) when 'smoke_only' then 5000*cast(smoke_small>0 as int)+150*cast(smoke_medium>0 as int)+10*cast(smoke_large>0 as int)+least(smoke_total,10)
    when 'fire_smoke' then 5000*cast(smoke_small>0 as int)+200*cast(fire_small>0 as int)+140*cast(smoke_medium>0 as int)+70*cast(fire_medium>0 as int)+15*cast(fire_large>0 as int)+5*cast(smoke_large>0 as int)+least(box_count,15) else 0 end as score from cat) select * from z""")  # fmt: skip
def selection_scores(spark, sf_dir):
    from ..functions.scoring import selection_score

    return _inventory(spark, sf_dir).select("img", "category", selection_score("category", F.col).cast("long").alias("score"))


@query("byte_identity", """with a as (select doc_id, sha256(text) as h from documents), b as (select doc_id, sha256(case when doc_id % 7 = 0 then text || ' ' else text end) as h from documents where doc_id % 11 <> 0),
    j as (select case when b.h is null then 'missing_b' when a.h = b.h then 'same' else 'changed' end as state from a left join b using (doc_id)) select state, count(*) as n from j group by 1""")  # fmt: skip
def byte_identity(spark, sf_dir):
    from .base import docs

    a = docs(spark, sf_dir, F.col("doc_id").alias("stem"), "text")
    b = a.where("stem % 11 <> 0").withColumn("text", F.when(F.col("stem") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return lab.byte_identity(a, b).groupBy("state").agg(F.count("*").alias("n"))
