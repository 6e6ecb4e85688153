import random

import numpy as np
from siftline.llm import mixing as mx


def table(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        d = "ab"[i % 4 == 0]
        rows.append((i, " ".join(rng.choice({"a": ["red", "blue", "tan"], "b": ["ox", "cow", "hen"]}[d]) for _ in range(rng.randrange(5, 40))), d))
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def totals(rows, names):
    return [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in names]


def test_targets_are_met(spark):
    t = table(spark)
    rows = mx.rates(t.select("doc_id", "text"), t, {"a": 0.5, "b": 0.5}).collect()
    a, b = totals(rows, "ab")
    assert abs(a / (a + b) - 0.5) < 0.01
    assert len(rows) == 400 and all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in rows)
    more = mx.rates(t.select("doc_id", "text"), t, {"a": 0.2, "b": 0.8}, budget=9000.0).collect()
    assert np.allclose(totals(more, "ab"), [1800, 7200], rtol=0.01)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in more)


def test_rates_agree_with_a_dense_solver(spark):
    rng = np.random.default_rng(0)
    n, p = rng.integers(1, 50, 60), rng.dirichlet([0.5, 0.5, 0.5], 60)
    points = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    rows = mx.fit_rates(points, [0.6, 0.3, 0.1]).collect()
    got, n, p = (np.array([r[c] for r in rows]) for c in ("rate", "n_tokens", "p"))
    natural = (n[:, None] * p).sum(0)
    goal = np.array([0.6, 0.3, 0.1]) * min(natural / [0.6, 0.3, 0.1])
    r = np.ones(60)
    for _ in range(20000):  # plain projected gradient
        r = np.clip(r - 1e-4 * n * (p @ ((r * n) @ p - goal)) / 10, 0, 1)
    ours, best = np.linalg.norm((got * n) @ p - goal), np.linalg.norm((r * n) @ p - goal)
    assert ours <= best + 0.002 * goal.sum()


def test_odd_rows(spark):
    t = table(spark)
    docs = spark.createDataFrame([(1, None, 5), (2, " \n", 5), (3, "red ox", 5), (3, "red ox", 5), (None, "cow", 5), (4, "hen " * 9000, 5)], "doc_id long, text string, rate int")
    rows = mx.rates(docs, t, {"a": 0.5, "b": 0.5}).collect()
    assert sorted((r.n_tokens, r.doc_id or 0) for r in rows) == [(0, 1), (0, 2), (1, 0), (2, 3), (2, 3), (9000, 4)]
    assert {r.rate for r in rows if r.n_tokens == 0} == {1.0}
    assert mx.rates(docs, t.limit(0)).count() == 6
    assert mx.rates(docs.limit(0), t).count() == 0
    one = spark.createDataFrame([(1, "red " * 400), (1, "ox cow hen " * 30), (None, "tan " * 300), (None, "ox hen " * 20)], "doc_id long, text string")
    mixed = mx.mix(one, t, targets={"a": 0.1, "b": 0.9}, protect="b").collect()  # what is thinned takes nothing of its id along
    assert {r.text for r in mixed if "ox" in r.text} == {"ox cow hen " * 30, "ox hen " * 20} and len(mixed) < 4
    kept = mx.mix(docs, t, targets={"a": 0.5, "b": 0.5})
    assert kept.columns == docs.columns and {1, 2} <= {r.doc_id for r in kept.collect()}


def test_query(spark):
    rows = mx.op2_mixing(spark, "/root/testdata/sf0.01").collect()
    names = ["prose", "junk", "toxic"]
    t = totals(rows, names)
    share = [x / sum(t) for x in t]
    print(share, {d: np.mean([r[f"p_{d}"] for r in rows]) for d in names}, np.mean([r.copies for r in rows]))
    assert len(rows) == 1000
    assert np.allclose(share, [0.9, 0.08, 0.02], atol=0.02)


def test_posteriors_match_brute_force(spark):
    import math

    import xxhash

    t = table(spark, 200)
    extra = spark.createDataFrame([(900, "red ox zebra", None), (901, None, None), (902, "  ", None), (903, "tan " * 50 + "cow", None)], t.schema)
    model = mx.fit_domains(t)
    rows = {r.doc_id: r for r in mx.posteriors(t.union(extra), model).collect()}
    bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) % 2**64 % mx.BUCKETS
    counts, docs = {d: {} for d in "ab"}, t.collect()
    for r in docs:
        for w in r.text.split():
            counts[r.domain][bucket(w)] = counts[r.domain].get(bucket(w), 0) + 1
    total = {d: sum(c.values()) for d, c in counts.items()}
    prior = {d: math.log(sum(r.domain == d for r in docs) / len(docs)) for d in "ab"}
    for r in [*docs, *extra.collect()]:
        words, score = (r.text or "").lower().split(), {}
        for d in "ab":
            score[d] = 0.0
            for w in words:
                x = bucket(w)
                if any(x in c for c in counts.values()):
                    mean = sum(c.get(x, 0) / total[e] for e, c in counts.items()) / 2
                    score[d] += math.log((counts[d].get(x, 0) + mx.STRENGTH * mean) / (total[d] + mx.STRENGTH))
        top = max(score.values())
        odds = {d: math.exp((s - top) / max(1, len(words)) ** 0.5 + prior[d]) for d, s in score.items()}
        want = [odds[d] / sum(odds.values()) for d in "ab"]
        assert rows[r.doc_id].n_tokens == len(words) and np.allclose(rows[r.doc_id].p, want, atol=1e-9), r


def test_binned_rates_follow_plain_steps(spark):
    """On bins so fine that each row has one, the result is that of steps on all rows."""
    rng = np.random.default_rng(3)
    n, p = rng.integers(0, 50, 80), rng.dirichlet([0.4, 0.4, 0.4], 80)
    points = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p, strict=True))], "id int, n_tokens long, p array<double>")
    runs = [{r.id: r.rate for r in mx.fit_rates(points, [0.6, 0.3, 0.1], grain=g).collect()} for g in (10**6, 256, 8)]
    natural = (n[:, None] * p).sum(0)
    goal = np.array([0.6, 0.3, 0.1]) * min(natural / [0.6, 0.3, 0.1])
    miss = [np.linalg.norm((np.array([x[i] for i in range(80)]) * n) @ p - goal) / goal.sum() for x in runs]
    assert max(abs(runs[0][i] - runs[1][i]) for i in range(80)) < 0.05
    assert all(m <= miss[0] + 0.002 for m in miss)  # coarse bins are made good on all rows
