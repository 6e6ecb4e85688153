"""Consensus, annotation scores and risk features against plain loops."""

import random

from pyspark.sql import functions as F
from test_matching import BOX, box, iou

from siftline.operators import ensemble

W = {"n": 0.31, "s": 0.33, "m": 0.36}


def mean_box(ms):
    t = sum(c * W[m] for m, c, _ in ms)
    return tuple(sum(b[k] * c * W[m] for m, c, b in ms) / t for k in range(4))


def clusters(dets, least_iou, floor, weighted):
    out = []
    key = (lambda d: (-(d[2] * W[d[0]]), d[0], d[3])) if weighted else (lambda d: (-d[2], d[0], d[3]))
    for m, c, f, b in sorted((d for d in dets if d[2] >= floor), key=key):
        near = [(iou(b, mean_box(ms)), -k) for k, (cc, ms) in enumerate(out) if cc == c and m not in [x[0] for x in ms] and iou(b, mean_box(ms)) >= least_iou]
        if near:
            out[-max(near)[1]][1].append((m, f, b))
        else:
            out.append((c, [(m, f, b)]))
    return [(c, len(ms), sum(W[m] * f for m, f, _ in ms), sum(f for _, f, _ in ms) / len(ms), max(f for _, f, _ in ms), mean_box(ms)) for c, ms in out]


def data():
    r = random.Random(21)
    dets = {i: [(r.choice("nsm"), r.randrange(2), r.choice([0.2, 0.4, 0.6, 0.9]) + r.random() / 100, box(r)) for _ in range(r.randrange(12))] for i in range(60)}
    gts = {i: [(r.randrange(2), box(r)) for _ in range(r.randrange(5))] for i in range(60)}
    cats = {i: r.choice(["fire_only", "smoke_only", "fire_smoke", "negative"]) for i in range(60)}
    return dets, gts, cats


def frame(spark, dets):
    rows = [(i, *d) for i, ds in dets.items() for d in ds]
    return spark.createDataFrame(rows, f"image int, model string, cls int, conf double, box {BOX}")


def test_weighted_consensus(spark):
    dets, _, _ = data()
    got = sorted((x.image, x.cls, x.votes, round(x.mean_conf, 6), tuple(round(v, 6) for v in x.box)) for x in ensemble.consensus(frame(spark, dets)).collect())
    want = sorted((i, c, v, round(f, 6), tuple(round(x, 6) for x in b)) for i, ds in dets.items() for c, v, _, f, _, b in clusters(ds, 0.30, 0.0, True) if v >= 2 and f >= 0.10)
    assert got == want


def test_risk_features(spark):
    dets, gts, cats = data()
    images = spark.createDataFrame([(i, c) for i, c in cats.items()], "image int, category string")
    truths = spark.createDataFrame([(i, *g) for i, gs in gts.items() for g in gs], f"image int, cls int, box {BOX}")
    rows = {x.image: x for x in ensemble.risk_features(images, truths, ensemble.clusters(frame(spark, dets))).collect()}
    assert len(rows) == 60
    for i, r in rows.items():
        cl = clusters(dets[i], 0.25, 0.10, False)
        agreed = [c for c in cl if c[1] >= 2]
        best = lambda b, among: max((iou(b, x[-1]) for x in among), default=0.0)
        same = [best(b, [x for x in agreed if x[0] == c]) for c, b in gts[i]]
        other = [best(b, [x for x in agreed if x[0] != c and x[2] >= 0.35]) for c, b in gts[i]]
        lost = [x for x in agreed if x[2] >= 0.35 and max((iou(x[-1], b) for c, b in gts[i] if c == x[0]), default=0.0) < 0.15]
        conflicts = sum(o >= 0.30 and s < 0.20 for s, o in zip(same, other, strict=True))
        lone = sum(x[1] == 1 and x[4] >= 0.55 for x in cl)
        unsupported = sum(s < 0.20 for s in same)
        risk = 2.5 * len(lost) + 1.5 * unsupported + 2.5 * conflicts + min(0.5 * lone, 2.0) + (0.75 if lost and cats[i] in ("fire_only", "smoke_only") else 0)
        assert (r.missing_fire, r.missing_smoke, r.unsupported_gt, r.class_conflicts, r.strong_singletons) == (sum(x[0] == 0 for x in lost), sum(x[0] == 1 for x in lost), unsupported, conflicts, lone)
        assert r.risk_score == round(risk, 4) and r.min_gt_support_iou == round(min(same, default=1.0), 6)


def test_annotation_scores(spark):
    dets, gts, _ = data()
    kind = f"array<struct<cls:int,box:{BOX}>>"
    found = {i: [(c, b) for c, v, _, f, _, b in clusters(ds, 0.30, 0.0, True) if v >= 2] for i, ds in dets.items()}
    df = spark.createDataFrame([(i, gts[i], found[i]) for i in gts], f"image int, t {kind}, c {kind}")
    for r in ensemble.score_annotations(df, "t", "c").select("image", F.col("annotation.score").alias("s")).collect():
        g, c = gts[r.image], found[r.image]
        if not g or not c:
            assert r.s == (1.0 if not g and not c else 0.0)
            continue
        best = lambda x, among: max((iou(x[1], y[1]) for y in among if y[0] == x[0]), default=0.0)
        a, b = [best(x, c) for x in g], [best(x, g) for x in c]
        want = 0.45 * sum(v >= 0.2 for v in a) / len(g) + 0.35 * sum(v >= 0.2 for v in b) / len(c) + 0.20 * sum(a) / len(g)
        assert abs(r.s - want) < 1e-9
