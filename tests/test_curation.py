from siftline.operators import lookup
from siftline.plans import curation

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_final_evaluation(spark):
    a, far = (0.0, 0.0, 0.2, 0.2), (0.5, 0.5, 0.9, 0.9)
    gts = spark.createDataFrame([("p", 1, 0, 0.04, a), ("p", 2, 1, 0.16, far), ("q", 3, 0, 0.04, a)], f"image string, id int, cls int, share double, box {BOX}")
    preds = spark.createDataFrame([("p", 10, 0, 0.04, 0.9, a), ("q", 11, 0, 0.16, 0.5, far), ("q", 12, 0, 0.04, 0.1, a), ("n", 13, 1, 0.04, 0.6, a)], f"image string, id int, cls int, share double, conf double, box {BOX}")
    images = spark.createDataFrame([(x,) for x in "pqnm"], "image string")
    r = curation.final_evaluation(gts, preds, images).first()
    assert r.foreign_predictions == 0 and r.recall == {0: 0.5, 1: 0.0} and r.macro_recall == 0.25
    assert (r.negative_images, r.alert_images, r.image_rate, r.smoke_image_rate) == (2, 1, 0.5, 0.5)
    assert {(x.cls, x.size, x.gt, x.tp, x.prediction_fp) for x in r.by_size} == {(0, "medium", 2, 1, 0), (0, "large", 0, 0, 1), (1, "large", 1, 0, 0), (1, "medium", 0, 0, 1)}


def test_layers(spark):
    items = spark.createDataFrame([("train", "a"), ("train", "b"), ("train", "c"), ("val", "d"), ("test", "e"), ("train", "f")], "split string, stem string")
    pairs = spark.createDataFrame([("a", "train", "b", "train", "exact_annotation")], "stem_a string, split_a string, stem_b string, split_b string, result string")
    edges = spark.createDataFrame([("c", "e", "train", "test"), ("c", "d", "train", "val"), ("d", "f", "val", "train")], "a string, b string, split_a string, split_b string")
    got = {}
    for r in curation.layered_manifest(items, pairs, edges).collect():
        got.setdefault(r.layer, set()).add(r.stem)
    assert got["clean_exact"] == set("acdef") and got["exclude_exact"] == {"b"}
    # c touches test; then only the edge d - f is alive
    assert got["clean_test_protected"] == set("adef") and got["frozen"] == set("ade")


def test_lookups(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    rows = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert sorted(r.v for r in lookup.with_default(rows, d, "k", "v").collect()) == ["unknown", "unknown", "x"]
    p = lookup.both_sides(spark.createDataFrame([(1, 2), (1, 9)], "k_a int, k_b int"), d, "k", ["v"])
    assert tuple(lookup.failures(p).first()) == (2, 1)
