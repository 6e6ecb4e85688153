import random

from pyspark.sql import functions as F

from siftline.functions import geometry as g
from siftline.functions import scoring as s
from siftline.operators import calibrate, dedup, labels, manifest, sampling, similarity


def test_parser_statuses(spark):
    text = "0 .5 .5 .2 .2\r\n1 1.0000005 .5 .1 .1\n0 1.001 .5 .1 .1\n0 .5 .5 0 .1\n0 .05 .5 .2 .1\n1.0 .5 .5 .1 .1\n2 .5 .5 .1 .1\n0 .5 .5 .1\n0 .5 .5 .1 .1 9\n0 x .5 .1 .1"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", " \n "), ("d", None)], "stem string, text string")
    rows = labels.parse(df).orderBy("line").collect()
    assert [r.status for r in rows] == ["ok", "outside", "out_of_range", "zero_area", "outside", "parse_error", "invalid_class", "malformed", "malformed", "parse_error"]
    assert labels.parse(df, float_classes=True).where("line = 5").first().status == "ok"
    assert [r.stem for r in labels.rejected_stems(labels.parse(df)).collect()] == ["a"]


def test_golden_clip(spark):
    df = spark.createDataFrame([("a", "train", 1, 0, 0.987891, 0.433333, 0.024219, 0.038889)], "stem string, split string, line int, cls int, xc double, yc double, w double, h double")
    out = labels.change_log(labels.sanitize(df)).first()
    assert out.action == "clip_boundary" and out.after == "0 0.9878907500 0.4333330000 0.0242185000 0.0388890000"
    kept = labels.sanitize(df, protected=F.col("split") == "train").first()
    assert kept.action == "keep"


def test_golden_calibration(spark):
    rows = spark.createDataFrame([(23, 12, 151, 14), (27, 25, 138, 10), (33, 38, 125, 4), (0, 0, 0, 0)], "tp int, fp int, tn int, fn int")
    got = [(round(r.precision, 4), round(r.recall, 4), round(r.f_beta, 4), round(r.accuracy, 2)) for r in calibrate.with_ratios(rows).collect()]
    assert got[0] == (0.6571, 0.6216, 0.6284, 0.87)
    assert got[1][2] == 0.675 and got[2][:3] == (0.4648, 0.8919, 0.7534) and got[3] == (0, 0, 0, 0)


def test_water_filling_golden(spark):
    cap = [("858", 200), ("3888", 5000), ("4232", 175)] + [(str(i), 5000) for i in range(7)]
    df = spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate(cap)], "camera string, capacity long, ord int")
    quota = {r.camera: r.quota for r in sampling.water_fill(df, "camera", 200, 2000).collect()}
    assert quota["858"] == 200 and quota["4232"] == 175 and quota["3888"] == 204 and sum(quota.values()) == 2000
    assert sorted(quota[str(i)] for i in range(7)) == [203] * 7


def two_pass(rows, quota):
    taken, seen, later = [], set(), []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        if r[1] is not None and r[1] != "" and r[1] in seen and not r[3]:
            later.append(r)
        else:
            taken.append(r)
            seen.add(r[1])
    return [r[0] for r in (taken + later)[:quota]]


def test_soft_diversity_is_the_two_pass_rule(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = [(i, rng.choice(["a", "b", "c", None, ""]), rng.randrange(4), rng.random() < 0.2) for i in range(30)]
        df = spark.createDataFrame([(*r, "x") for r in rows], "id int, key string, score int, rare boolean, cat string")
        got = [r.id for r in sampling.soft_diverse_top_k(df, "cat", [F.desc("score"), F.col("id")], ["key"], 12, F.col("rare")).orderBy("rank").collect()]
        assert got == two_pass(rows, 12)


def test_even_spacing(spark):
    df = spark.createDataFrame([("a", i) for i in range(17)] + [("b", i) for i in range(3)], "k string, i int")
    for n in (2, 5, 9, 16, 17):
        got = sorted(r.i for r in sampling.evenly_spaced(df.where("k = 'a'"), "k", ["i"], n).collect())
        assert got == sorted({round(j * 16 / (n - 1)) for j in range(n)})
        cut = sorted(r.i for r in sampling.evenly_spaced(df.where("k = 'a'"), "k", ["i"], n, truncate=True).collect())
        assert cut == sorted({int(j * (16 / (n - 1))) for j in range(n)})
    assert [r.i for r in sampling.evenly_spaced(df.where("k = 'b'"), "k", ["i"], 1).collect()] == [1]


def test_hamming_join_is_exact(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 14))) % 2**64 for b in base for _ in range(60)] + base[:5]
    signed = [(i, h - 2**64 if h >> 63 else h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame([*signed, (9999, None)], "id int, h long")
    for radius in (2, 10):
        want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= radius}
        assert {(r.id_a, r.id_b) for r in similarity.hamming_join(df, "h", radius, "id").collect()} == want


def test_hash_bits_and_names(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "img_0009", "img_12", "model_epoch7.pt"), ("", "abc", "abc1", "last.pt")], "h string, a string, b string, e string")
    r = df.select(s.hash_bits("h").alias("h"), s.filename_sequence("a", "b").alias("q"), s.epoch_number("e").alias("e"), s.path_stem("e").alias("p")).collect()
    assert r[0].h == -1 and r[1].h is None and tuple(r[0].q) == (True, 3, True) and tuple(r[1].q) == (False, None, False)
    assert (r[0].e, r[1].e, r[0].p) == (7, 1_000_000_000, "model_epoch7")


def test_image_hashes_and_letterbox():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 255, (90, 120)).astype(float)
    assert similarity.phash64(x) == similarity.phash64(x.copy()) and similarity.dhash64(np.tile(np.arange(120.0), (90, 1))) == 2**64 - 1
    n = np.arange(32)
    small = similarity.area_resize(x, 32, 32)
    low = [[sum(small[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in n for j in n) * (2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1) / 16 for v in range(8)] for u in range(8)]
    flat = np.array(low).ravel()
    assert f"{similarity.phash64(x):064b}" == "".join("1" if v > np.median(flat[1:]) else "0" for v in flat)
    for shape, to in (((7, 5, 3), (4, 9)), ((6, 8), (6, 3)), ((3, 3), (10, 10))):
        img = rng.integers(0, 255, shape, dtype=np.uint8)
        hat = lambda n, m: np.array([[max(0, 1 - abs(min(max((i + 0.5) * n / m - 0.5, 0), n - 1) - k)) for k in range(n)] for i in range(m)])
        want = np.einsum("ia,jb,ab...->ij...", hat(shape[0], to[0]), hat(shape[1], to[1]), img.astype(float))
        assert np.abs(similarity.linear_resize(img.astype(float), *to) - want).max() < 1e-9
        assert np.abs(similarity.linear_resize(img, *to).astype(float) - want).max() <= 0.5 + 1e-9
    raw = np.array([[5, 5, 2, 2, 0.9, 0.1], [1, 1, 2, 2, 0.2, 0.2], [3, 4, 1, 1, 0.1, 0.6]]).T
    boxes, conf, cls = similarity.decode_head(raw, 0.3)
    assert boxes.tolist() == [[4, 4, 6, 6], [2.5, 3.5, 3.5, 4.5]] and conf.tolist() == [0.9, 0.6] and cls.tolist() == [0, 1]
    out, scale, (left, top) = similarity.letterbox(rng.integers(0, 255, (100, 200, 3), dtype=np.uint8), 64)
    assert out.shape == (3, 64, 64) and scale == 0.32 and (left, top) == (0, 16)


def test_decoded_images_and_files(spark, tmp_path):
    import struct
    import zlib

    from siftline.sources import readers, sinks

    def png(w, h, value):
        raw = b"".join(b"\0" + bytes([value, 20, 30] * w) for _ in range(h))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    pics = tmp_path / "p"
    pics.mkdir()
    (pics / "a.png").write_bytes(png(16, 12, 200))
    (pics / "b.png").write_bytes(png(16, 12, 200))
    (pics / "c.png").write_bytes(b"not an image")
    img = readers.decoded_images(spark, str(pics))
    assert {r.stem: r.width for r in img.collect()} == {"a": 16, "b": 16, "c": None}
    h = similarity.image_hashes(img).collect()
    assert len({(r.phash, r.dhash, r.pixel_sha256) for r in h}) == 1
    m = similarity.pixel_metrics(spark.createDataFrame([("a", "b")], "stem_a string, stem_b string"), similarity.thumbnails(img, 16)).first()
    assert m.psnr == 999.0 and m.gray_mae == 0 and round(m.color_corr, 9) == 1
    assert readers.valid_images(spark, str(pics)).count() == 2
    found = readers.images(spark, str(pics), content=True)
    assert readers.resolve_stems(spark.createDataFrame([("a",), ("z",)], "stem string"), found).where("path is null").count() == 1
    (tmp_path / "m.txt").write_text("# note\n/x/one.jpg\n\ntwo\none\n")
    assert sorted(r.stem for r in readers.manifest(spark, str(tmp_path / "m.txt"), comments=True).collect()) == ["one", "two"]
    assert readers.manifest_repeats(spark, str(tmp_path / "m.txt")).first().n == 2
    sinks.write_manifest(spark.createDataFrame([("b",), ("a",), ("b",)], "stem string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert readers.class_contract("names:\n  0: fire\n  1: smoke\n") == readers.class_contract("nc: 2\nnames: [fire, 'smoke']") == ["fire", "smoke"]


def test_archives_and_documents(spark, tmp_path):
    import json
    import zipfile

    from siftline.sources import readers, sinks

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("l/a.txt", "0 .5 .5 .1 .1")
        z.writestr("x/a.xml", "<annotation><object><name>fire</name></object><object><name>smoke</name></object></annotation>")
        z.writestr("big.txt", "y" * 5000)
    rows = readers.zip_members(spark, str(tmp_path / "x.zip"), [".txt", ".xml"], most_bytes=1000, contents=True)
    assert sorted(r.member for r in rows.collect()) == ["l/a.txt", "x/a.xml"]
    assert rows.where("member like '%xml'").select(readers.voc_classes("text").alias("c")).first().c == ["fire", "smoke"]
    coco = spark.createDataFrame([(json.dumps({"images": [{"id": 1}], "annotations": [{"id": 1, "category_id": 1}], "categories": [{"id": 2, "name": "b"}, {"id": 1, "name": "a"}]}),)], "text string")
    r = readers.coco_summary(coco).first()
    assert (r.n_images, r.n_annotations, r.categories) == (1, 1, ["a", "b"])
    (tmp_path / "p.jsonl").write_text('{"image": "i", "predictions": [{"class_id": 1, "confidence": 0.5, "xyxy": [0,0,1,1]}]}\n\n{"image": "j", "predictions": []}\n')
    assert readers.detections(spark, str(tmp_path / "p.jsonl"), "n").count() == 1
    sinks.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"a": 1, "b": "x"}
    sinks.write_lock(spark, str(tmp_path / "lock"), spark.range(1))
    try:
        sinks.write_lock(spark, str(tmp_path / "lock"), spark.range(1))
        raise AssertionError("a second lock was written")
    except Exception as e:  # noqa: BLE001
        assert "EXISTS" in str(e).upper()


def test_label_comparison_and_decisions(spark):
    kind = "array<struct<cls:int,xc:double,yc:double,w:double,h:double>>"
    one, moved, other = (0, 0.5, 0.5, 0.1, 0.1), (0, 0.5 + 1e-12, 0.5, 0.1, 0.1), (1, 0.5, 0.5, 0.1, 0.1)
    rows = [(1, [one], [one]), (2, [one], [moved]), (3, [one], [one, one]), (4, [one], [other]), (5, [one], [(0, 0.6, 0.5, 0.1, 0.1)]), (6, None, [one]), (7, [], [])]
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", dedup.compare_annotations(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in df.orderBy("i").collect()] == ["exact_annotation", "equivalent_annotation", "box_count_conflict", "class_conflict", "geometry_conflict", "missing_label", "exact_annotation"]
    pairs = spark.createDataFrame([("a", "train", "b", "train", "exact_annotation"), ("c", "train", "d", "test", "exact_annotation"), ("e", "val", "f", "val", "class_conflict"), ("g", "val", "h", "train", "geometry_conflict")], "stem_a string, split_a string, stem_b string, split_b string, result string")
    got = {(r.stem, r.role) for r in dedup.decide(pairs).collect()}
    assert got == {("a", "keep"), ("b", "exclude"), ("d", "keep"), ("c", "exclude"), ("e", "quarantine"), ("f", "quarantine"), ("h", "exclude"), ("g", "quarantine")}
    o = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    ok = manifest.accounting(o, {"x": o.where("stem = 'a'"), "y": o.where("stem <> 'a'")}).first()
    bad = manifest.accounting(o, {"x": o.where("stem <= 'b'"), "y": o.where("stem = 'b'")}).first()
    assert ok.holds and not bad.holds and (bad.n_lost, bad.n_overlap) == (1, 1)


def test_percentiles_by_rank_are_those_of_the_aggregate(spark, monkeypatch):
    from siftline.operators import evaluate

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random() * 100])) for _ in range(300)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    read = lambda by: sorted(((*(r[c] or "" for c in by), *(round(r[c], 9) for c in ("n", "mean", "median", "p95", "p99", "min", "max"))) for r in evaluate.latency(df, "v", by).collect()))
    plain = read(["k"]), read([])
    monkeypatch.setattr(evaluate, "GATHERED", 0)
    assert (read(["k"]), read([])) == plain and len(plain[0]) == 4


def test_geometry(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.4, 0.2)], "xc double, yc double, w double, h double").withColumn("b", g.corners("xc", "yc", "w", "h"))
    r = df.select(g.overflow("b").alias("o"), g.centre(g.clipped("b")).alias("c"), g.iou("b", "b").alias("i"), g.size_bucket(F.lit(0.005)).alias("z"), g.aspect_difference(F.lit(2.0), F.lit(1.0)).alias("a"), s.relation(F.lit("test"), F.lit("train")).alias("r"), s.component_type(F.array(F.lit("val"), F.lit("train"))).alias("t")).first()
    assert (round(r.o, 9), round(r.c.w, 9), r.i, r.z, r.a, r.r, r.t) == (0.1, 0.3, 1.0, "medium", 0.5, "train_test", "train_val")


def test_filters_reach_the_scan_of_a_table(spark, tmp_path):
    from siftline.sources import readers, schemas, sinks

    rows = spark.createDataFrame([("a", "train", 4, 3, 1.25, "0f", "f0"), ("b", "val", 4, 3, 1.5, "01", "10")], schemas.HASHES)
    sinks.write_csv(rows, str(tmp_path / "h"), digits={"aspect": 3})
    plan = readers.csv(spark, str(tmp_path / "h"), schemas.HASHES).where("split = 'val'").select("stem")._jdf.queryExecution().toString()
    assert "EqualTo(split,val)" in plan and "ReadSchema: struct<stem:string,split:string>" in plan
    assert readers.hashes(spark, str(tmp_path / "h")).where("split = 'val'").first().p == 1


def test_agreement_chooses_among_several(spark):
    from siftline.operators import evaluate

    box = lambda x: (x, 0.0, x + 1, 1.0)
    kind = "img int, id int, conf double, box struct<x1:double,y1:double,x2:double,y2:double>"
    a = spark.createDataFrame([(1, 1, 0.9, box(0.0)), (1, 2, 0.8, box(0.01)), (1, 3, 0.7, box(5.0)), (2, 4, 0.5, box(0.0))], kind)
    b = spark.createDataFrame([(1, 11, 0.85, box(0.01)), (1, 12, 0.6, box(0.02)), (1, 13, 0.7, box(9.0))], kind)
    r = evaluate.agreement(a, b, ["img"]).first()
    # the surest takes the nearest, the second what is left
    assert (r.n_a, r.n_b, r.matched, r.match_rate) == (4, 3, 2, 0.5)
    assert abs(r.max_conf_delta - 0.2) < 1e-9 and abs(r.mean_conf_delta - 0.125) < 1e-9
    assert evaluate.agreement(a.where("img = 2"), b, ["img"]).first().max_conf_delta == float("inf")
