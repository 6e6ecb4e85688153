import math

import numpy as np
from siftline.llm import embedding as em


def brute(rows, threshold=0.95):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    u = [None if i is None else unit(v) for i, v in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold:
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    names = {}
    for i, (k, _) in enumerate(rows):
        names.setdefault(find(i), []).append(k)
    return sorted((k if k is not None else -1, n[i], -1 if k is None else min(names[find(i)])) for i, (k, _) in enumerate(rows))


def result(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for size in (1, 1, 2, 3, 30, 90):
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((i, [float(np.float32(x)) for x in base + 0.05 * rng.standard_normal(16)]))
            i += 1
    rows += [(500 + j, rows[7][1]) for j in range(40)] + [(600 + j, [float(x) for x in rng.standard_normal(16)]) for j in range(150)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0] * 15 + [None]), (704, []), (705, [float("inf")] + [1.0] * 15), (None, rows[7][1])]
    rows += [(706, [1.0, 2.0]), (707, [2.0, 4.0]), (708, [2.0, 4.0]), (708, [-1.0, 0.5]), (709, [1e-200, 2e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as c", "'x' as kept")
    assert result(em.embedding_links(df, block=32)) == brute(rows)


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(d + "/embeddings.parquet").collect()]
    got, want = result(em.op9_embedding(spark, d)), brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_empty(spark):
    assert em.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_close_groups_larger_than_a_list_are_joined(spark):
    rng = np.random.default_rng(8)
    rows, c = [], 0.97
    for pair in range(3):
        one, two = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for centre in (one, c * one + math.sqrt(1 - c * c) * two):
            rows += [(len(rows) + j, [float(x) for x in centre + 0.0005 * rng.standard_normal(64)]) for j in range(20)]
    want = brute(rows)
    assert {w[1] for w in want} == {39} and len({w[2] for w in want}) == 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(em.embedding_links(df, block=8)) == want


def test_lists_under_the_recall_give_way_to_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(rng.standard_normal((40, 8)), 5, axis=0) + 0.1 * rng.standard_normal((200, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # a recall that no audit can reach
    assert result(em.embedding_links(df, recall=1.1, rounds=1, block=16)) == brute(rows)
