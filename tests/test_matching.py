"""Folds against plain loops on random boxes."""

import random

from pyspark.sql import functions as F

from siftline.operators import ensemble, evaluate, matching

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    area = lambda q: max(0.0, q[2] - q[0]) * max(0.0, q[3] - q[1])
    u = area(a) + area(b) - both
    return both / u if u > 0 else 0.0


def box(r):
    x, y = r.randrange(4), r.randrange(4)
    return (float(x), float(y), float(x + r.randrange(4)), float(y + r.randrange(1, 4)))


def cases(n=60):
    r = random.Random(11)
    for i in range(n):
        gts = [(100 * i + k, box(r)) for k in range(r.randrange(6))]
        preds = [(100 * i + k, r.choice([0.1, 0.3, 0.5, 0.5, 0.9]), box(r)) for k in range(r.randrange(7))]
        yield i, gts, preds


def greedy(gts, preds, least):
    used, out = set(), set()
    for pid, conf, b in sorted(preds, key=lambda p: (-p[1], p[0])):
        best, top = None, -1.0
        for gid, gb in gts:
            v = iou(gb, b)
            if gid not in used and v >= least and v > top:
                best, top = gid, v
        if best is not None:
            used.add(best)
            out.add((pid, best, round(top, 9)))
    return out


def frames(spark):
    every = list(cases())
    g = spark.createDataFrame([(i, k, b) for i, gts, _ in every for k, b in gts], f"img int, id int, box {BOX}")
    p = spark.createDataFrame([(i, k, c, b) for i, _, preds in every for k, c, b in preds], f"img int, id int, conf double, box {BOX}")
    return every, g, p


def test_greedy_and_its_prefixes(spark):
    every, g, p = frames(spark)
    rows = matching.match_detections(g, p, ["img"], 0.3).collect()
    for least in (0.0, 0.4, 0.6):
        got = {(r.pred_id, r.gt_id, round(r.iou, 9)) for r in rows if r.gt_id is not None and r.pred_id is not None and r.conf >= least}
        want = set().union(*(greedy(gts, [x for x in preds if x[1] >= least], 0.3) for _, gts, preds in every))
        assert got == want
    assert {r.gt_id for r in rows if r.gt_id is not None} == {k for _, gts, _ in every for k, _ in gts}
    assert {r.pred_id for r in rows if r.pred_id is not None} == {k for _, _, preds in every for k, *_ in preds}


def test_global_matching_nms_and_summary(spark):
    every, _, _ = frames(spark)
    r = random.Random(2)
    rows, want = [], {}
    for i, gts, preds in every:
        a = [(r.randrange(2), b) for _, b in gts]
        b = [(r.randrange(2), x) for _, _, x in preds]
        rows.append((i, a, b))
        pairs = sorted(((iou(x, y), j, k) for j, (c, x) in enumerate(a) for k, (d, y) in enumerate(b) if c == d and iou(x, y) >= 0.3), reverse=True)
        left, right, n, total = set(), set(), 0, 0.0
        for v, j, k in pairs:
            if j not in left and k not in right:
                left.add(j)
                right.add(k)
                n, total = n + 1, total + v
        mean = 1.0 if not a and not b else total / n if n else 0.0
        want[i] = (n, n / len(a) if a else 1.0, n / len(b) if b else 1.0, round(mean, 9))
    df = spark.createDataFrame(rows, f"i int, a array<struct<cls:int,box:{BOX}>>, b array<struct<cls:int,box:{BOX}>>")
    m = df.withColumn("m", matching.global_match(F.col("a"), F.col("b"), 0.3)).select("i", matching.match_summary(F.col("a"), F.col("b"), F.col("m")).alias("s"))
    assert {x.i: (x.s.matched, x.s.coverage_a, x.s.coverage_b, round(x.s.mean_iou, 9)) for x in m.collect()} == want
    kept = df.select("i", matching.nms(F.col("b"), 0.4).alias("k")).collect()
    for (_, _, b), x in zip(rows, sorted(kept, key=lambda q: q.i), strict=True):
        out = []
        for _, q in b:
            if all(iou(q, o) <= 0.4 for o in out):
                out.append(q)
        assert [tuple(y.box) for y in x.k] == out


def test_clusters_and_risk(spark):
    r = random.Random(5)
    w = {"n": 0.31, "s": 0.33, "m": 0.36}
    dets = [(i, r.choice("nsm"), r.randrange(2), r.choice([0.05, 0.2, 0.4, 0.6, 0.9]) + r.random() / 100, box(r)) for i in range(40) for _ in range(r.randrange(9))]
    df = spark.createDataFrame(dets, f"image int, model string, cls int, conf double, box {BOX}")
    got = sorted((x.image, x.cls, tuple(x.models), round(x.score, 6)) for x in ensemble.clusters(df).collect())
    want = []

    def mean(ms):
        t = sum(c * w[m] for m, c, _ in ms)
        return tuple(sum(b[k] * c * w[m] for m, c, b in ms) / t for k in range(4))

    for i in range(40):
        out = []
        for _, m, c, f, b in sorted((d for d in dets if d[0] == i and d[3] >= 0.1), key=lambda d: (-d[3], d[1], d[4])):
            near = [(iou(b, mean(ms)), -k) for k, (cc, ms) in enumerate(out) if cc == c and m not in [x[0] for x in ms] and iou(b, mean(ms)) >= 0.25]
            if near:
                out[-max(near)[1]][1].append((m, f, b))
            else:
                out.append((c, [(m, f, b)]))
        want += [(i, c, tuple(sorted(x[0] for x in ms)), round(sum(w[m] * f for m, f, _ in ms), 6)) for c, ms in out]
    assert got == sorted(want)
    images = spark.createDataFrame([(1000, "negative"), (0, "fire_only")], "image int, category string")
    truths = spark.createDataFrame([(0, 0, (0.0, 0.0, 1.0, 1.0))], f"image int, cls int, box {BOX}")
    rows = {x.image: x for x in ensemble.risk_features(images, truths, ensemble.clusters(df)).collect()}
    assert rows[1000].min_gt_support_iou == 1.0 and rows[1000].risk_score == 0.0 and rows[1000].gt_boxes == 0
    assert rows[0].gt_boxes == 1


def test_annotation_scores_cover_the_empty_cases(spark):
    one = [(0, (0.0, 0.0, 2.0, 2.0))]
    kind = f"array<struct<cls:int,box:{BOX}>>"
    df = spark.createDataFrame([(1, [], []), (2, [], one), (3, one, []), (4, one, one)], f"i int, t {kind}, c {kind}")
    got = {r.i: r.annotation for r in ensemble.score_annotations(df, "t", "c").collect()}
    assert [got[i].score for i in (1, 2, 3, 4)] == [1.0, 0.0, 0.0, 1.0]
    assert (got[2].missing_consensus, got[3].unsupported_gt, got[4].supported_gt) == (1, 1, 1)


def test_agreement_without_matches(spark):
    a = spark.createDataFrame([(1, 1, 0.5, (0.0, 0.0, 1.0, 1.0))], f"img int, id int, conf double, box {BOX}")
    b = a.withColumn("box", F.struct(*(F.lit(v).alias(c) for v, c in zip((5.0, 5.0, 6.0, 6.0), ("x1", "y1", "x2", "y2"), strict=True))))
    r = evaluate.agreement(a, b, ["img"]).first()
    assert (r.matched, r.match_rate, r.max_conf_delta) == (0, 0.0, float("inf"))
