import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.functions import scoring
from siftline.operators import hamming, similarity


def near(h, radius):
    """All pairs by brute force."""
    found = set()
    for s in range(0, len(h), 500):
        i, j = np.nonzero(np.bitwise_count(h[s : s + 500, None] ^ h[None, :]) <= radius)
        found |= {(x + s, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x + s < y}
    return found


def clustered(rng, n):
    base = rng.integers(0, 2**64, n // 4, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 25), replace=False)) for _ in range(n)], np.uint64)
    return base[rng.integers(0, len(base), n)] ^ flips


def test_both_ways_of_a_block_agree_with_brute_force():
    h = clustered(np.random.default_rng(5), 1500)
    h[:600] = h[0]  # copies: candidates in more than one piece
    for radius in (0, 1, 2, 3, 5, 10, 13):
        for way in (hamming._all, hamming._indexed):
            got = [(i, j) for x, y in way(h, h, radius) for i, j in zip(x.tolist(), y.tolist(), strict=True) if i < j]
            assert len(got) == len(set(got)) and set(got) == near(h, radius)
    assert hamming.candidates(h, h, 10) >= 600 * 600
    assert not list(hamming.close_pairs(h, h[:0], 10)) and not list(hamming.close_pairs(h[:0], h, 10))


def test_blocks_find_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(hamming, "SMALL", 100)
    h = clustered(np.random.default_rng(6), 900)
    df = spark.createDataFrame([(i, int(x), i % 3) for i, x in enumerate(h.view(np.int64).tolist())], "id int, h long, label int").repartition(3)
    for radius in (3, 10, 20):
        want = near(h, radius)
        rows = similarity.hamming_join(df, "h", radius, "id", ["label"]).collect()
        assert sorted((r.id_a, r.id_b) for r in rows) == sorted(want)
        assert all(r.distance == int(np.bitwise_count(h[r.id_a] ^ h[r.id_b])) and r.label_a == r.id_a % 3 and r.label_b == r.id_b % 3 for r in rows)
        counts = {(r.same, r.distance): r.n for r in similarity.distance_counts(df, "h", radius, "id", "label").collect()}
        assert sum(counts.values()) == len(want) and sum(n for (same, _), n in counts.items() if same) == sum(i % 3 == j % 3 for i, j in want)


def test_equal_and_null_keys_make_no_pair(spark):
    rows = [("a", 1, "x"), ("a", 3, "x"), ("b", 1, None), ("b", 1, "x"), (None, 1, "x"), ("c", None, "x")]
    df = spark.createDataFrame(rows, "id string, h long, label string")
    want = [("a", "b", 0), ("a", "b", 0), ("a", "b", 1), ("a", "b", 1)]
    for radius in (2, 20):
        assert sorted((r.id_a, r.id_b, r.distance) for r in similarity.hamming_join(df, "h", radius, "id").collect()) == want
        counts = sorted((str(r.same), r.distance, r.n) for r in similarity.distance_counts(df, "h", radius, "id", "label").collect())
        assert counts == [("None", 0, 1), ("None", 1, 1), ("True", 0, 1), ("True", 1, 1)]
    none = df.where("id = 'z'")
    assert similarity.hamming_join(none, "h", 20, "id").count() == similarity.hamming_join(none, "h", 2, "id").count() == 0
    assert tuple(similarity.threshold_counts(similarity.distance_counts(none, "h", 20, "id"), "distance", [16, 20], "n").first()) == (0, 0)


def test_wide_radius_past_the_former_nested_loop(spark):
    """28,000 hashes: probes of a band would be 771 million rows."""
    h = np.random.default_rng(7).integers(0, 2**64, 28_000, dtype=np.uint64)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h.view(np.int64).tolist())], "id int, h long")
    want = sum(int((np.bitwise_count(h[i] ^ h[i + 1 :]) <= 20).sum()) for i in range(len(h)))
    assert similarity.threshold_counts(similarity.distance_counts(df, "h", 20, "id"), "distance", [20], "n").first().le_20 == want
    assert similarity.hamming_join(df, "h", 20, "id").count() == want


def test_metrics_are_those_of_the_column_expressions(spark):
    nan, inf = float("nan"), float("inf")
    arrays = [[1.0, 2.0, 4.0], [1.0, 2.0, 4.0], [0.5, -2.0, 3.0], [2.0, 2.0, 2.0], [1.0, nan, 3.0], [1.0, None, 3.0], [1.0, 2.0], [inf, 1.0, 2.0], [0.0, 0.0, 0.0], None]
    arrays += [r.tolist() for r in np.random.default_rng(8).normal(size=(40, 3))]
    df = spark.createDataFrame([(i, 7, x) for i, x in enumerate(arrays)], "id int, h long, e array<double>")
    got = {(r.id_a, r.id_b): (r.corr, r.mae, r.psnr) for r in similarity.hamming_metrics(df, "h", 20, "id", "e").collect()}
    listed = similarity.pair_metrics(similarity.hamming_join(df, "h", 20, "id", ["e"]).where("e_a is not null and e_b is not null"), "e_a", "e_b")
    want = {(r.id_a, r.id_b): (r.corr, r.mae, r.psnr) for r in listed.collect()}
    assert len(got) == 50 * 49 // 2 and len(want) == 49 * 48 // 2
    for pair, values in want.items():
        for x, y in zip(got[pair], values, strict=True):
            assert (x is None) == (y is None), (pair, got[pair], values)
            assert x is None or np.isclose(x, y, rtol=1e-13, atol=1e-13, equal_nan=True), (pair, got[pair], values)
    # the arrays of pairs stay where they are: nothing of the array leaves
    assert similarity.hamming_metrics(df, "h", 20, "id", "e").columns == ["id_a", "id_b", "distance", "corr", "mae", "psnr"]


def peak_of_arrays(lengths):
    """Bytes that arrays of these lengths take besides the table, at most."""
    values = pa.array(np.random.default_rng(9).random(sum(lengths), dtype=np.float32))
    column = pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)])
    tracemalloc.start()
    held = hamming.Arrays(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, held, values.to_numpy()


def test_arrays_of_a_unit_take_no_more_than_they_hold():
    peak, _, values = peak_of_arrays([64] * 50_000)
    assert peak < values.nbytes
    peak, held, values = peak_of_arrays([4] * 2000 + [100_000])  # one long array does not widen the others
    assert peak < 1 << 20
    assert np.allclose(held.sum, np.r_[values[:8000].reshape(-1, 4).astype(float).sum(1), values[8000:].astype(float).sum()])


def test_gates_are_counted_as_listed(spark):
    nan, inf = float("nan"), float("inf")
    arrays = [[1.0, 2.0, 4.0], [1.0, 2.0, 4.0], [2.0, 2.0, 2.0], [1.0, nan, 3.0], [1.0, None, 3.0], [1.0, 2.0], [], [], [inf, 1.0, 2.0], None, [1e200, 1.0, 1e200], [1e200, 1.0, 1e200]]
    arrays += [r.tolist() for r in np.random.default_rng(8).normal(size=(40, 3))]
    df = spark.createDataFrame([(i, 7, x, i % 3 or None) for i, x in enumerate(arrays)], "id int, h long, e array<double>, label int")
    gates = {"open": {"corr": -2.0, "mae": 9e300, "color": -900.0}, "middle": {"corr": 0.0, "mae": 1.0, "color": -3.0}, "tight": {"corr": 0.9, "mae": 0.5, "color": 0.0}}
    listed = similarity.hamming_metrics(df, "h", 20, "id", "e", ["label"]).withColumns({"gates": scoring.passed_gates("corr", "mae", "psnr", gates), "same": F.col("label_a") == F.col("label_b")})
    want = sorted(map(str, listed.select(F.explode("gates").alias("gate"), "same").groupBy("gate", "same").count().collect()))
    counted = similarity.gate_counts(df, "h", 20, "id", "e", gates, "label")
    assert sorted(map(str, counted.withColumnRenamed("n", "count").collect())) == want and len(want) > 6
    relation = F.when(F.col("same"), "same_label").otherwise("cross_label")
    one = similarity.gate_profile(listed.withColumn("relation", relation))
    two = similarity.gate_profile(counted.select(F.array("gate").alias("gates"), relation.alias("relation"), "n"), weight="n")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
