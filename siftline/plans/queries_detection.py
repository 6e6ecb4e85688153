"""Matching, evaluation, ensembles, mining and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scoring as s
from ..operators import calibrate, dedup, ensemble, evaluate, lookup, matching, mining
from ..sources.sinks import union_of_columns
from . import curation
from .base import SQL_BOX, boxes, docs, query, read, sql_iou

_FO = f"with {SQL_BOX}, a as (select * from box where side = 'F'), b as (select * from box where side = 'O')"
_TH = [0.10, 0.25, 0.50, 0.75]


def _sides(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumnRenamed("bid", "id")
    return b.where("side = 'F'"), b.where("side = 'O'")


_BEST = f"{_FO}, best as (select a.bid, a.cls, a.share, max(coalesce({sql_iou()}, 0.0)) as best_iou from a left join b on a.img = b.img and a.cls = b.cls group by 1, 2, 3)"


@query("best_iou_per_gt", f"{_BEST} select bid as id, round(best_iou, 8) as best_iou from best")
def best_iou_per_gt(spark, sf_dir):
    gts, preds = _sides(spark, sf_dir)
    return matching.best_iou(gts, preds, ["img", "cls"]).select("id", F.round("best_iou", 8).alias("best_iou"))


@query("best_iou_recall", f"{_BEST} select cls, case when share < 0.005 then 'small' when share < 0.05 then 'medium' else 'large' end as size, count(*) as gt, count(*) filter (where best_iou >= 0.5) as tp, round(count(*) filter (where best_iou >= 0.5) / count(*), 8) as recall from best group by 1, 2")
def best_iou_recall(spark, sf_dir):
    gts, preds = _sides(spark, sf_dir)
    best = matching.best_iou(gts, preds, ["img", "cls"]).join(gts.select("id", g.size_bucket("share").alias("size")), "id")
    return best.groupBy("cls", "size").agg(F.count("*").alias("gt"), F.count_if(F.col("best_iou") >= 0.5).alias("tp")).withColumn("recall", F.round(s.ratio("tp", "gt"), 8))


_GREEDY = f"""{_FO}, p as (select *, row_number() over (partition by img, cls order by conf desc, bid) as i from b),
    cand as (select p.img, p.cls, p.i, p.bid as pred_id, p.conf, a.bid as gt_id, {sql_iou("a", "p")} as iou from p join a on a.img = p.img and a.cls = p.cls), good as (select * from cand where iou >= 0.5),
    walk(img, cls, i, used, pred_id, gt_id, iou) as (select distinct img, cls, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as bigint), cast(null as double) from good
    union all select w.img, w.cls, n.i, case when n.gt_id is null then w.used else list_append(w.used, n.gt_id) end, n.pred_id, n.gt_id, n.iou from walk w, lateral (select g.i, g.pred_id, g.gt_id, g.iou from (select q.i, q.pred_id, q.gt_id, q.iou from good q where q.img = w.img and q.cls = w.cls and q.i > w.i and not list_contains(w.used, q.gt_id) order by q.i, q.iou desc, q.gt_id limit 1) g) n)"""


def _matches(spark, sf_dir):
    gts, preds = _sides(spark, sf_dir)
    return gts, preds, matching.match_detections(gts, preds, ["img", "cls"])


@query("box_match_greedy", f"{_GREEDY.replace('with box', 'with recursive box', 1)} select pred_id, gt_id, round(iou, 8) as iou from walk where gt_id is not null")
def box_match_greedy(spark, sf_dir):
    _, _, m = _matches(spark, sf_dir)
    return m.where("gt_id is not null and pred_id is not null").select("pred_id", "gt_id", F.round("iou", 8).alias("iou"))


@query("size_aware_recall", f"""{_GREEDY.replace('with box', 'with recursive box', 1)}, t as (select unnest([0.1::double, 0.25, 0.5, 0.75]) as threshold), hit as (select w.gt_id, w.pred_id, b.conf from walk w join b on b.bid = w.pred_id where w.gt_id is not null),
    gs as (select a.bid, a.cls, case when a.share < 0.005 then 'small' when a.share < 0.05 then 'medium' else 'large' end as size, hit.conf as mc from a left join hit on hit.gt_id = a.bid), l as (select threshold, cls, size, count(*) as gt, count(*) filter (where mc >= threshold) as tp, avg(mc) filter (where mc >= threshold) as mean from gs, t group by 1, 2, 3),
    ps as (select b.cls, case when b.share < 0.005 then 'small' when b.share < 0.05 then 'medium' else 'large' end as size, b.conf from b where b.bid not in (select pred_id from hit)), r as (select threshold, cls, size, count(*) as fp from ps, t where conf >= threshold group by 1, 2, 3)
    select coalesce(l.threshold, r.threshold) as threshold, coalesce(l.cls, r.cls) as cls, coalesce(l.size, r.size) as size, coalesce(gt, 0) as gt, coalesce(tp, 0) as tp, coalesce(gt, 0) - coalesce(tp, 0) as fn, coalesce(fp, 0) as prediction_fp, round(mean, 8) as tp_mean_conf from l full join r on l.threshold = r.threshold and l.cls = r.cls and l.size = r.size""")  # fmt: skip
def size_aware_recall(spark, sf_dir):
    gts, preds, m = _matches(spark, sf_dir)
    sized = lambda x: x.withColumn("size", g.size_bucket("share"))
    out = evaluate.size_aware(m, sized(gts), sized(preds), _TH)
    return out.select("threshold", "cls", "size", "gt", "tp", "fn", "prediction_fp", F.round("tp_mean_conf", 8).alias("tp_mean_conf"))


_GLOBAL = f"""with recursive {SQL_BOX}, a as (select * from box where side = 'F'), b as (select * from box where side = 'O'), na as (select img, count(*) as n from a group by 1), nb as (select img, count(*) as n from b group by 1),
    ai as (select *, row_number() over (partition by img order by bid) - 1 as pos from a), bi as (select *, row_number() over (partition by img order by bid) - 1 as pos from b), c as (select ai.img, ai.pos as ia, bi.pos as ib, {sql_iou("ai", "bi")} as iou from ai join bi on ai.img = bi.img and ai.cls = bi.cls),
    r as (select *, row_number() over (partition by img order by iou desc, ia desc, ib desc) as k from c where iou >= 0.3), w(img, k, ua, ub, n, total) as (select distinct img, cast(0 as bigint), cast([] as bigint[]), cast([] as bigint[]), cast(0 as int), cast(0 as double) from r
    union all select w.img, r.k, case when f then list_append(ua, ia) else ua end, case when f then list_append(ub, ib) else ub end, case when f then n + 1 else n end, case when f then total + iou else total end from w join (select * from r) r on r.img = w.img and r.k = w.k + 1, lateral (select not list_contains(w.ua, r.ia) and not list_contains(w.ub, r.ib) as f) q),
    last as (select img, max_by(n, k) as n, max_by(total, k) as total from w group by 1)"""


@query("box_match_global", f"{_GLOBAL} select na.img, coalesce(l.n, 0) as matched, round(coalesce(l.n, 0) / na.n, 8) as coverage_a, round(coalesce(l.n, 0) / nb.n, 8) as coverage_b, round(case when coalesce(l.n, 0) = 0 then 0.0 else l.total / l.n end, 8) as mean_iou from na join nb on na.img = nb.img left join last l on l.img = na.img")
def box_match_global(spark, sf_dir):
    gts, preds = _sides(spark, sf_dir)
    a = matching.per_image(gts, ["img"], [F.col("id")], ["id", "cls", "box"], "a")
    b = matching.per_image(preds, ["img"], [F.col("id")], ["id", "cls", "box"], "b")
    m = a.join(b, "img").withColumn("m", matching.global_match(F.col("a"), F.col("b"), 0.3))
    return m.select("img", matching.match_summary(F.col("a"), F.col("b"), F.col("m")).alias("s")).select("img", "s.*").withColumns({x: F.round(x, 8) for x in ("coverage_a", "coverage_b", "mean_iou")})


@query("nms", f"""with recursive {SQL_BOX}, o as (select *, row_number() over (partition by img, cls order by conf desc, bid) as i from box), cf as (select b.bid, list(a.bid) as l from o a join o b on a.img = b.img and a.cls = b.cls and a.i < b.i and {sql_iou()} > 0.5 group by b.bid),
    w(img, cls, i, kept) as (select img, cls, i, [bid] from o where i = 1 union all select w.img, w.cls, o.i, case when cf.l is not null and len(list_intersect(w.kept, cf.l)) > 0 then w.kept else list_append(w.kept, o.bid) end from w join o on o.img = w.img and o.cls = w.cls and o.i = w.i + 1 left join cf on cf.bid = o.bid),
    last as (select img, cls, max_by(kept, i) as kept from w group by 1, 2), k as (select img, cls, unnest(kept) as id from last) select k.img, k.cls, k.id, box.conf from k join box on box.bid = k.id""")  # fmt: skip
def nms(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumnRenamed("bid", "id")
    arrays = matching.per_image(b, ["img", "cls"], [-F.col("conf"), F.col("id")], ["id", "conf", "box"], "boxes")
    return arrays.select("img", "cls", F.explode(matching.nms(F.col("boxes"), 0.5)).alias("k")).select("img", "cls", "k.id", "k.conf")


def _detections(spark, sf_dir):
    name = F.element_at(F.array(F.lit("n"), F.lit("s"), F.lit("m")), F.col("model") + 1)
    return boxes(spark, sf_dir, numbered=False).where("side = 'O' and w > 0 and h > 0").select(F.col("img").alias("image"), name.alias("model"), "cls", "conf", "box")


@query("consensus_clusters")
def consensus_clusters(spark, sf_dir):
    c = ensemble.clusters(_detections(spark, sf_dir), "image")
    return c.groupBy("cls", "votes").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query("weighted_consensus")
def weighted_consensus(spark, sf_dir):
    return ensemble.consensus(_detections(spark, sf_dir), "image").groupBy("cls", "votes").agg(F.count("*").alias("n"), F.round(F.sum("mean_conf"), 6).alias("conf"))


@query("risk_features")
def risk_features(spark, sf_dir):
    gts = boxes(spark, sf_dir, numbered=False).where("side = 'F' and w > 0 and h > 0").select(F.col("img").alias("image"), "cls", "box")
    images = gts.groupBy("image").agg(s.category(F.bool_or(F.col("cls") == 0), F.bool_or(F.col("cls") == 1)).alias("category"))
    found = ensemble.clusters(_detections(spark, sf_dir), "image")
    return ensemble.risk_features(images, gts, found).withColumn("reason", s.reason())


@query("annotation_scores")
def annotation_scores(spark, sf_dir):
    gts = boxes(spark, sf_dir, numbered=False).where("side = 'F'").groupBy(F.col("img").alias("image")).agg(F.collect_list(F.struct("cls", "box")).alias("truths"))
    agreed = ensemble.consensus(_detections(spark, sf_dir), "image").groupBy("image").agg(F.collect_list(F.struct("cls", "box")).alias("found"))
    return ensemble.score_annotations(gts.join(agreed, "image"), "truths", "found").select("image", "annotation.*")


_RUN = _GREEDY.replace("with box", "with recursive box", 1).replace("a as (select * from box where side = 'F'), b as (select * from box where side = 'O')", """b as (select * from box where w > 0 and h > 0), a as (select bid, img, cls, conf + (bid % 3) / 1000000.0 as conf, x1 + gap as x1, y1, x2 + gap as x2, y2 from (select *, case when bid % 50 = 0 then 9.0 else w * 0.002 end as gap from b))""").replace("iou >= 0.5", "iou >= 0.95")


@query("run_agreement", f"""{_RUN}, hit as (select w.iou, abs(b.conf - a.conf) as gap from walk w join b on b.bid = w.pred_id join a on a.bid = w.gt_id where w.gt_id is not null), n as (select count(*) as n from b)
    select n as n_a, n as n_b, count(*) as matched, round(count(*) / n, 8) as match_rate, round(avg(iou), 8) as mean_iou, round(avg(gap), 8) as mean_conf_delta, round(max(gap), 8) as max_conf_delta from hit, n group by n""")  # fmt: skip
def run_agreement(spark, sf_dir):
    a = boxes(spark, sf_dir).where("w > 0 and h > 0").withColumnRenamed("bid", "id")
    # run b: the same boxes a little aside, every fiftieth moved away, confidences a little off
    gap = F.when(F.col("id") % 50 == 0, 9.0).otherwise(F.col("w") * 0.002)
    aside = F.struct(*((F.col(f"box.{c}") + gap if c[0] == "x" else F.col(f"box.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")))
    b = a.withColumns({"box": aside, "conf": F.col("conf") + (F.col("id") % 3) / 1_000_000})
    out = evaluate.agreement(a, b, ["img", "cls"])
    return out.select("n_a", "n_b", "matched", *(F.round(c, 8).alias(c) for c in ("match_rate", "mean_iou", "mean_conf_delta", "max_conf_delta")))


@query("equivalence_gate", "select true as counts_equal, true as delta_small, 'PASS' as verdict, 0.0::double as max_delta")
def equivalence_gate(spark, sf_dir):
    m = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 6).alias("v"))
    delta = evaluate.largest_delta(m, m, ["event_type"], ["n", "v"])
    return delta.select(*evaluate.gate({"counts_equal": F.lit(True), "delta_small": F.col("max_delta") <= 1e-6}), "max_delta")


_AL = [25.0, 50.0, 100.0, 150.0, 250.0]


def _alerts(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("image"), "event_type", kind.alias("cls"), F.col("value").alias("conf"))


_ALERT = """with t as (select unnest([25.0::double, 50.0, 100.0, 150.0, 250.0]) as threshold), n as (select count(distinct user_id) as images from events), u as (select user_id, max(value) as m, max(value) filter (where event_type in ('click','view')) as f, max(value) filter (where event_type not in ('click','view')) as s from events group by 1),
    b as (select threshold, count(*) filter (where value >= threshold) as boxes from events, t group by 1), r as (select threshold, count(*) filter (where m >= threshold) as alert_images, count(*) filter (where f >= threshold) as fire_alert_images, count(*) filter (where s >= threshold) as smoke_alert_images from u, t group by 1)"""


@query("alert_rates", f"{_ALERT} select threshold, alert_images, fire_alert_images, smoke_alert_images, cast(boxes as bigint) as alert_boxes, images, round(alert_images / images, 8) as image_rate from r join b using (threshold), n")
def alert_rates(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    out = mining.alert_rates(a, a.select("image").distinct().count(), _AL)
    return out.select("threshold", "alert_images", "fire_alert_images", "smoke_alert_images", "alert_boxes", "images", F.round("image_rate", 8).alias("image_rate"))


@query("alert_rate_pivot", "with t as (select unnest([25.0, 100.0]) as threshold), u as (select event_type, user_id, max(value) as m from events group by 1, 2), r as (select event_type, threshold, count(*) filter (where m >= threshold) as k from u, t group by 1, 2) select event_type, max(k) filter (where threshold = 25) as \"2500\", max(k) filter (where threshold = 100) as \"10000\" from r group by 1")
def alert_rate_pivot(spark, sf_dir):
    r = mining.alert_rates(_alerts(spark, sf_dir), 1, [25.0, 100.0], by=["event_type"])
    return mining.by_threshold(r, ["event_type"], "alert_images", [25.0, 100.0])


@query("relative_reduction", """with t as (select unnest([25.0::double, 50.0, 100.0]) as threshold), u as (select event_type, user_id, max(value) as m from events group by 1, 2), r as (select event_type, threshold, count(*) filter (where m >= threshold) as k from u, t group by 1, 2)
    select r.event_type, r.threshold, r.k as alert_images, b.k as baseline, r.k - b.k as delta, round((b.k - r.k) / nullif(b.k, 0), 8) as reduction from r left join r b on b.event_type = 'view' and b.threshold = r.threshold and r.threshold < 100""")  # fmt: skip
def relative_reduction(spark, sf_dir):
    r = mining.alert_rates(_alerts(spark, sf_dir), 1, [25.0, 50.0, 100.0], by=["event_type"]).select("event_type", "threshold", "alert_images")
    base = r.where("event_type = 'view' and threshold < 100")
    return mining.relative_reduction(r, base, "threshold", "alert_images").withColumn("reduction", F.round("reduction", 8))


@query("negative_severity", "with u as (select user_id, max(value) / 300.0 as c from events group by 1) select case when c >= 0.75 then 'EXTREME' when c >= 0.5 then 'HARD' when c >= 0.25 then 'MODERATE' when c >= 0.1 then 'LOW' else 'NONE' end as severity, count(*) as n from u group by 1")
def negative_severity(spark, sf_dir):
    u = read(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") / 300).alias("c"))
    return u.groupBy(s.severity("c").alias("severity")).agg(F.count("*").alias("n"))


_MODELS = {"n": "view", "s": "click", "m": "error"}
_EV = """with c as (select user_id as image, event_type, least(1.0, value / 300.0) as conf, cast(event_id % 2 as int) as cls from events), q as (select image, event_type, coalesce(max(conf) filter (where cls=0), 0) as f, coalesce(max(conf) filter (where cls=1), 0) as s from c group by 1, 2),
    p as (select image, event_type, greatest(f, s) as top, case when greatest(f, s) <= 0 then 'none' when f >= s then 'fire' else 'smoke' end as tc from q),
    m as (select n.image, [n.top, s.top, m.top] as confs, [n.tc, s.tc, m.tc] as tcs from p n join p s on s.image = n.image and s.event_type = 'click' join p m on m.image = n.image and m.event_type = 'error' where n.event_type = 'view'),
    v as (select image, confs, len(list_filter(confs, lambda x: x >= 0.1)) as votes_010, len(list_filter(confs, lambda x: x >= 0.25)) as votes_025, len(list_filter(confs, lambda x: x >= 0.5)) as votes_050, list_max(confs) as max_conf, list_sum(confs)/3 as mean_conf,
    len(list_filter(list_zip(confs, tcs), lambda x: x[1] >= 0.25 and x[2] = 'fire')) as fire_votes, len(list_filter(list_zip(confs, tcs), lambda x: x[1] >= 0.25 and x[2] = 'smoke')) as smoke_votes from m)"""


def _votes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("image"), "event_type", F.least(F.lit(1.0), F.col("value") / 300).alias("conf"), (F.col("event_id") % 2).cast("int").alias("cls"))
    each = {m: mining.prediction_summary(e.where(F.col("event_type") == t), e.where(F.col("event_type") == t)) for m, t in _MODELS.items()}
    return mining.classify(mining.merge_models(each), list(_MODELS))


@query("ensemble_votes", f"""{_EV} select image, votes_010, votes_025, votes_050, fire_votes, smoke_votes, case when fire_votes = 0 and smoke_votes = 0 then 'none' when fire_votes > smoke_votes then 'fire' when smoke_votes > fire_votes then 'smoke' else 'mixed' end as consensus_class,
    case when votes_025 = 3 or votes_050 >= 2 then 'EXTREME' when votes_025 >= 2 or max_conf >= 0.75 then 'HARD' when votes_025 = 1 or votes_010 >= 1 then 'MODERATE' else 'EASY' end as severity, round(0.30*mean_conf + 0.25*(votes_025/3) + 0.25*(votes_050/3) + 0.20*max_conf, 8) as hardness from v""")  # fmt: skip
def ensemble_votes(spark, sf_dir):
    v = _votes(spark, sf_dir)
    long = ("votes_010", "votes_025", "votes_050")
    return v.select("image", *(F.col(c).cast("long").alias(c) for c in long), F.col("fire_votes").cast("long").alias("fire_votes"), F.col("smoke_votes").cast("long").alias("smoke_votes"), "consensus_class", "severity", F.round("hardness", 8).alias("hardness"))


_SAMPLES = """x as (select d.doc_id, n_chars, l.quality = 0 as positive, (n_chars % 1000) / 50.0 as score, case d.lang when 'en' then 'stable' when 'fr' then 'fire_only' else 'smoke_only' end as grp from documents d join labels l using (doc_id))"""
_RATIOS = "case when tp+fp=0 then 0 else tp/(tp+fp) end as precision, case when tp+fn=0 then 0 else tp/(tp+fn) end as recall, (tp+tn)/(tp+fp+tn+fn) as accuracy"
_F2 = "case when 4*precision+recall=0 then 0 else 5*precision*recall/(4*precision+recall) end as f_beta"


def _samples(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "n_chars", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    grp = F.when(F.col("lang") == "en", "stable").when(F.col("lang") == "fr", "fire_only").otherwise("smoke_only")
    return d.select("doc_id", (F.col("quality") == 0).alias("positive"), ((F.col("n_chars") % 1000) / 50).alias("score"), grp.alias("grp"))


_CONF = "count(*) filter (where {f} and positive) as tp, count(*) filter (where {f} and not positive) as fp, count(*) filter (where not {f} and not positive) as tn, count(*) filter (where not {f} and positive) as fn"
_CURVE = f"with {_SAMPLES}, t as (select i as grid_index, i * 0.5::double as threshold from range(0, 40) r(i)), c as (select grid_index, threshold, {_CONF.format(f='(score >= threshold)')} from x, t group by 1, 2), m as (select *, {_RATIOS} from c), f as (select *, {_F2} from m)"


@query("threshold_curve", f"{_CURVE} select grid_index, threshold, tp, fp, tn, fn, round(precision, 8) as precision, round(recall, 8) as recall, round(f_beta, 8) as f_beta from f")
def threshold_curve(spark, sf_dir):
    t = calibrate.grid(spark, threshold=[i * 0.5 for i in range(40)])
    c = calibrate.cumulative(_samples(spark, sf_dir), t, "score")
    return c.select("grid_index", "threshold", "tp", "fp", "tn", "fn", *(F.round(x, 8).alias(x) for x in ("precision", "recall", "f_beta")))


@query("threshold_calibration", f"{_CURVE} select grid_index, threshold, tp, fp, tn, fn, round(f_beta, 8) as f_beta from f order by f.f_beta desc, f.recall desc, f.precision desc, grid_index limit 1")
def threshold_calibration(spark, sf_dir):
    t = calibrate.grid(spark, threshold=[i * 0.5 for i in range(40)])
    c = calibrate.on_grid(_samples(spark, sf_dir), t, F.col("score") >= F.col("threshold"))
    best = calibrate.best(c, [F.col("f_beta"), F.col("recall"), F.col("precision")])
    return best.select("grid_index", "threshold", "tp", "fp", "tn", "fn", F.round("f_beta", 8).alias("f_beta"))


_GRID = {"vote_conf": [0.10, 0.15, 0.20, 0.25, 0.30, 0.35], "missing": [0.25, 0.30, 0.35, 0.40, 0.45, 0.50], "unsupported": [0.05, 0.10, 0.15, 0.20, 0.25]}
_AXIS = "{0}_axis as (select unnest({1}::double[]) as {0}, unnest(range({2})) as {0}_i)"
_WEIGHED = " + ".join(f"{w} * {{0}}[{i + 1}]" for i, w in enumerate(s.MODEL_WEIGHTS.values()))
_FLAG = "(case when {p} then {w} < unsupported else len(list_filter({c}, lambda y: y >= vote_conf)) >= 2 and {w} >= missing end)"


@query("ensemble_rule_grid", f"""with c as (select user_id as image, event_type, least(1.0, value / 300.0) as conf, event_id % 2 as cls from events), q as (select image, {", ".join(f"[{', '.join(f"coalesce(max(conf) filter (where cls = {k} and event_type = '{t}'), 0)" for t in _MODELS.values())}] as c{k}" for k in (0, 1))} from c group by 1),
    z as (select image, image % 3 = 0 as p0, image % 3 = 1 as p1, image % 4 = 0 as positive, c0, c1, {_WEIGHED.format("c0")} as w0, {_WEIGHED.format("c1")} as w1 from q), {", ".join(_AXIS.format(n, v, len(v)) for n, v in _GRID.items())},
    g as (select (vote_conf_i * 6 + missing_i) * 5 + unsupported_i as grid_index, vote_conf, missing, unsupported from vote_conf_axis, missing_axis, unsupported_axis), x as (select g.*, positive, {_FLAG.format(p="p0", w="w0", c="c0")} or {_FLAG.format(p="p1", w="w1", c="c1")} as flagged from z, g),
    k as (select grid_index, vote_conf, missing, unsupported, {_CONF.format(f="flagged")} from x group by 1, 2, 3, 4), m as (select *, {_RATIOS} from k), f as (select *, {_F2} from m) select grid_index, vote_conf, missing, unsupported, tp, fp, tn, fn, round(f_beta, 8) as f_beta from f""")  # fmt: skip
def ensemble_rule_grid(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("image"), "event_type", F.least(F.lit(1.0), F.col("value") / 300).alias("conf"), (F.col("event_id") % 2).alias("cls"))
    most = lambda k, t: F.coalesce(F.max(F.when((F.col("cls") == k) & (F.col("event_type") == t), F.col("conf"))), F.lit(0.0))
    per = e.groupBy("image").agg(F.array(*(F.array(*(most(k, t) for t in _MODELS.values())) for k in (0, 1))).alias("confs"))
    weighted = F.transform("confs", lambda c: sum((w * c[i] for i, w in enumerate(list(s.MODEL_WEIGHTS.values())[1:], 1)), s.MODEL_WEIGHTS["n"] * c[0]))
    image = F.col("image")
    samples = per.select("confs", weighted.alias("weighted"), F.array(image % 3 == 0, image % 3 == 1).alias("present"), (image % 4 == 0).alias("positive"))
    out = calibrate.ensemble_rule(samples, calibrate.grid(spark, **_GRID))
    return out.select("grid_index", *_GRID, "tp", "fp", "tn", "fn", F.round("f_beta", 8).alias("f_beta"))


_GROUPED = f"""with {_SAMPLES}, t as (select i, i * 0.5::double as threshold from range(0, 42) r(i)), p as (select grp, i, threshold, {_CONF.format(f='(score >= threshold)')} from x, t group by 1, 2, 3),
    j as (select a.i * 42 * 42 + b.i * 42 + c.i as grid_index, a.threshold as t_fire_only, b.threshold as t_smoke_only, c.threshold as t_stable, a.tp+b.tp+c.tp as tp, a.fp+b.fp+c.fp as fp, a.tn+b.tn+c.tn as tn, a.fn+b.fn+c.fn as fn from p a, p b, p c where a.grp = 'fire_only' and b.grp = 'smoke_only' and c.grp = 'stable'),
    m as (select *, {_RATIOS} from j), f as (select *, {_F2} from m), k as (select *, recall >= 0.85 and precision >= 0.35 as on_target from f)
    select grid_index, t_fire_only, t_smoke_only, t_stable, tp, fp, tn, fn, on_target from k order by on_target desc, f_beta desc, case when on_target then precision else recall end desc, case when on_target then accuracy else precision end desc, case when on_target then recall else accuracy end desc, grid_index limit 1"""


@query("grouped_calibration", _GROUPED)
def grouped_calibration(spark, sf_dir):
    t = calibrate.grid(spark, threshold=[i * 0.5 for i in range(42)])
    out = calibrate.grouped_search(_samples(spark, sf_dir), t, "grp", "score", ["fire_only", "smoke_only", "stable"])
    return out.select("grid_index", "t_fire_only", "t_smoke_only", "t_stable", "tp", "fp", "tn", "fn", "on_target")


@query("latency_summary", "select event_type, count(*) as n, round(avg(value), 8) as mean, round(median(value), 8) as median, round(quantile_cont(value, 0.95), 8) as p95, round(quantile_cont(value, 0.99), 8) as p99, min(value) as min, max(value) as max from events group by 1")
def latency_summary(spark, sf_dir):
    out = evaluate.latency(read(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 8).alias(c) for c in ("mean", "median", "p95", "p99")), "min", "max")


@query("model_ranking", "with m as (select event_type, round(avg(value), 4) as score from events group by 1) select event_type, score, rank() over (order by score desc) as rank from m")
def model_ranking(spark, sf_dir):
    m = read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("score"))
    return evaluate.ranked(m, "score").withColumn("rank", F.col("rank").cast("long"))


@query("json_predictions", "with j as (select event_type, cast(json_extract(props, '$.k') as bigint) as k, value from events) select event_type, count(*) filter (where k is not null) as parsed, cast(sum(k) as bigint) as total, count(*) filter (where value >= 25) as strong from j group by 1")
def json_predictions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"), "value")
    return e.groupBy("event_type").agg(F.count("p.k").alias("parsed"), F.sum("p.k").alias("total"), F.count_if(F.col("value") >= 25).alias("strong"))


@query("class_mapping_vote", "with c as (select source, lang, count(*) as n from documents group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, lang desc) as k, sum(n) over (partition by source) as total from c) select source, lang, n as votes, cast(total as bigint) as total, round(n / total, 8) as share from r where k = 1")
def class_mapping_vote(spark, sf_dir):
    c = docs(spark, sf_dir, "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return evaluate.majority_mapping(c, "source", "lang").withColumn("share", F.round("share", 8))


@query("macro_recall", f"{_BEST}, r as (select cls, count(*) filter (where best_iou >= 0.3) / count(*) as recall from best group by 1) select round(avg(recall), 8) as macro_recall from r")
def macro_recall(spark, sf_dir):
    gts, preds = _sides(spark, sf_dir)
    r = matching.best_iou(gts, preds, ["img", "cls"]).groupBy("cls").agg((F.count_if(F.col("best_iou") >= 0.3) / F.count("*")).alias("recall"))
    return evaluate.macro_recall(r, [], "recall").select(F.round("macro_recall", 8).alias("macro_recall"))


@query("negative_rate", """with neg as (select distinct l_orderkey as img from lineitem group by 1 having bool_and(l_linestatus = 'O')), p as (select l_orderkey as img, l_suppkey % 2 as cls, (l_extendedprice % 1000)/1000.0 as conf from lineitem join neg on neg.img = l_orderkey), u as (select img, max(conf) as m, max(conf) filter (where cls = 0) as f, max(conf) filter (where cls = 1) as s from p group by 1), t as (select unnest([0.1::double, 0.25, 0.5, 0.75]) as threshold)
    select threshold, count(*) as images, count(*) filter (where m >= threshold) as alert_images, count(*) filter (where f >= threshold) as fire_alert_images, count(*) filter (where s >= threshold) as smoke_alert_images from u, t group by 1""")  # fmt: skip
def negative_rate(spark, sf_dir):
    b = boxes(spark, sf_dir, numbered=False)
    empty = b.groupBy("img").agg(F.bool_and(F.col("side") == "O").alias("e")).where("e").select(F.col("img").alias("image"))
    preds = b.select(F.col("img").alias("image"), "cls", "conf")
    return evaluate.negative_rate(empty, preds, _TH).select("threshold", "images", "alert_images", "fire_alert_images", "smoke_alert_images")


@query("detections_by_category", f"""with {SQL_BOX}, c as (select img, case when bool_or(cls=0) and bool_or(cls=1) then 'fire_smoke' when bool_or(cls=0) then 'fire_only' else 'smoke_only' end as category from box where side='F' group by 1), d as (select img, count(*) as n, count(*) filter (where conf >= 0.25) as strong from box where side = 'O' and w > 0 and h > 0 group by 1)
    select category, count(*) as images, cast(sum(coalesce(n,0)) as bigint) as detections, cast(sum(coalesce(strong,0)) as bigint) as strong, count(*) filter (where strong > 0) as images_with_strong from c left join d using (img) group by 1""")  # fmt: skip
def detections_by_category(spark, sf_dir):
    gts = boxes(spark, sf_dir, numbered=False).where("side = 'F'")
    images = gts.groupBy(F.col("img").alias("image")).agg(s.category(F.bool_or(F.col("cls") == 0), F.bool_or(F.col("cls") == 1)).alias("category"))
    return lookup.sums_by_category(_detections(spark, sf_dir), images)


@query("review_index", "with u as (select user_id, max(value) / 300.0 as conf from events group by 1) select user_id, row_number() over (order by conf desc, user_id) as index from u where conf >= 0.25")
def review_index(spark, sf_dir):
    u = read(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") / 300).alias("top_conf"))
    review, _ = mining.residual_split(u)
    return dedup.with_rank(review, [F.desc("top_conf"), F.col("user_id")], "index").select("user_id", "index")


@query("residual_split", "with u as (select user_id, max(value) / 300.0 as c from events group by 1) select count(*) filter (where c >= 0.25) as review, count(*) filter (where not c >= 0.25) as remaining from u")
def residual_split(spark, sf_dir):
    u = read(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") / 300).alias("top_conf"))
    review, rest = mining.residual_split(u)
    return review.agg(F.count("*").alias("review")).crossJoin(F.broadcast(rest.agg(F.count("*").alias("remaining"))))


@query("split_lookup", "with s as (select doc_id, lang from documents where doc_id % 4 <> 0) select coalesce(s.lang, 'unknown') as lang, count(*) as n from labels left join s using (doc_id) group by 1")
def split_lookup(spark, sf_dir):
    known = docs(spark, sf_dir, "doc_id", "lang").where("doc_id % 4 <> 0")
    return lookup.with_default(read(spark, sf_dir, "labels"), known, "doc_id", "lang").groupBy("lang").agg(F.count("*").alias("n"))


@query("pair_lookup_failures", "with p as (select doc_id as a, doc_id + 7 as b from documents) select count(*) as pairs, count(*) filter (where x.doc_id is null or y.doc_id is null) as failures from p left join labels x on x.doc_id = a left join labels y on y.doc_id = b")
def pair_lookup_failures(spark, sf_dir):
    pairs = docs(spark, sf_dir, "doc_id").select(F.col("doc_id").alias("doc_id_a"), (F.col("doc_id") + 7).alias("doc_id_b"))
    return lookup.failures(lookup.both_sides(pairs, read(spark, sf_dir, "labels"), "doc_id", ["quality"]))


@query("archive_mapping_votes", "with n as (select doc_id, lang as name from documents union all select doc_id, 'x' from documents where doc_id % 9 = 0), c as (select doc_id, cast(length(lang) + doc_id % 2 as int) as cls from documents), s as (select doc_id, min(name) as name from n group by 1 having count(distinct name) = 1) select cls, name, count(*) as n from s join c using (doc_id) group by 1, 2")
def archive_mapping_votes(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang")
    names = d.select("doc_id", F.col("lang").alias("name")).unionByName(d.where("doc_id % 9 = 0").select("doc_id", F.lit("x").alias("name")))
    numbers = d.select("doc_id", (F.length("lang") + F.col("doc_id") % 2).cast("int").alias("cls"))
    return lookup.mapping_votes(names, numbers, "doc_id")


@query("report_union", "with a as (select event_type as model, count(*) as n, cast(null as double) as mean from events where event_type = 'view' group by 1), b as (select event_type as model, cast(null as bigint) as n, round(avg(value), 8) as mean from events where event_type = 'click' group by 1) select * from a union all select * from b")
def report_union(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("event_type", "model")
    a = e.where("model = 'view'").groupBy("model").agg(F.count("*").alias("n"))
    b = e.where("model = 'click'").groupBy("model").agg(F.round(F.avg("value"), 8).alias("mean"))
    return union_of_columns([a, b], first="model")


_FINAL = f"""{_GREEDY.replace('with box', 'with recursive box', 1).replace("where side = 'O')", "where side = 'O' and conf >= 0.25)", 1)}, hit as (select gt_id from walk where gt_id is not null), rc as (select a.cls, count(hit.gt_id) / count(*) as recall from a left join hit on hit.gt_id = a.bid group by 1),
    neg as (select distinct img from box where img not in (select img from a)), al as (select b.img, b.cls from b join neg on neg.img = b.img), n as (select count(*) as n from neg)"""


@query("final_evaluation", f"{_FINAL} select cast(0 as bigint) as foreign_predictions, round((select recall from rc where cls = 0), 8) as recall_fire, round((select recall from rc where cls = 1), 8) as recall_smoke, round((select avg(recall) from rc), 8) as macro_recall, (select n from n) as negative_images, (select count(distinct img) from al) as alert_images, round((select count(distinct img) from al) / (select n from n), 8) as image_rate, round((select count(distinct img) from al where cls = 0) / (select n from n), 8) as fire_image_rate")
def final_evaluation(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumnsRenamed({"bid": "id", "img": "image"})
    gts, preds = b.where("side = 'F'"), b.where("side = 'O' and conf >= 0.25")
    out = curation.final_evaluation(gts, preds, b.select("image").distinct())
    rounded = lambda c, name: F.round(c, 8).alias(name)
    return out.select("foreign_predictions", rounded(F.col("recall")[0], "recall_fire"), rounded(F.col("recall")[1], "recall_smoke"), rounded("macro_recall", "macro_recall"), "negative_images", "alert_images", rounded("image_rate", "image_rate"), rounded("fire_image_rate", "fire_image_rate"))
