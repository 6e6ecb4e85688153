import math
import random
from collections import Counter

import numpy as np
from siftline.llm import toxicity as tx


def test_block_max_search_is_exact():
    rng = random.Random(4)
    vectors = [tx.unit({rng.randrange(30): rng.random() for _ in range(rng.randrange(5))}) for _ in range(700)]
    vectors += vectors[:80]
    index = tx.BlockMaxIndex(vectors, 30)
    for _ in range(120):
        q = tx.unit({rng.randrange(30): rng.random() for _ in range(rng.randrange(6))})
        brute = sorted(((sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors)), key=lambda x: (-round(x[0], 12), x[1]))
        brute = [x for x in brute if x[0] > 0][:9]
        got = index.top(np.array([*q], np.int64), np.array([*q.values()]), 9)
        assert [i for _, i in got] == [i for _, i in brute] and np.allclose([s for s, _ in got], [s for s, _ in brute])


def test_blocks_under_the_bound_are_skipped():
    """Without maxima that tell blocks apart nothing could be skipped; here most blocks never reach the table."""
    rng = random.Random(5)
    vectors = [tx.unit({g * 10 + t: 1 + rng.random() for t in range(10)} | {100 + rng.randrange(500): 1.0}) for g in range(10) for _ in range(200)]
    index = tx.BlockMaxIndex(vectors, 600)
    assert (index.column[:100] >= 0).all()
    index.table[index.most[:, index.column[5]] == 0] = np.nan  # blocks without the query's group
    got = index.top(np.arange(10), np.full(10, 10**-0.5), 5)
    assert len(got) == 5 and all(i < 200 and s > 0.7 for s, i in got)


def brute_scores(examples, texts, k=15, prior_weight=0.1, rest=1.5, min_docs=4, min_chi2=20.0, max_terms=4096):
    """(vote, score) of every text by the definition, with plain dictionaries."""
    examples = sorted(examples, key=lambda x: x[0])
    n, n1 = len(examples), sum(y for *_, y in examples)
    held = [set(tx.terms_of(t)) for _, t, _ in examples]
    df, pos = Counter(t for h in held for t in h), Counter(t for h, (*_, y) in zip(held, examples, strict=True) if y for t in h)
    chi = {}
    for t, m in df.items():
        a = pos[t]
        gap = a * (n - m - n1 + a) - (m - a) * (n1 - a)
        chi[t] = n * gap * gap / max(m * (n - m) * n1 * (n - n1), 1)
    tested = sorted((t for t, m in df.items() if m >= min_docs and chi[t] >= min_chi2), key=lambda t: (-chi[t], t))[:max_terms]
    idf = {t: math.log((1 + n) / (1 + m)) + 1 for t, m in df.items()}

    def vector(text):
        words, terms = Counter(tx.words_of(text)), tx.terms_of(text)
        if not words:
            return {}
        length = rest * (1 + math.log(sum(words.values())))
        v = {("t", t): (1 + math.log(terms[t])) * idf[t] for t in tested if terms[t]}
        whole = {w: (1 + math.log(c)) * idf.get(w, math.log(1 + n) + 1) for w, c in words.items()}
        size = math.sqrt(sum(x * x for x in whole.values()))
        v |= {("w", w): x * length / size for w, x in whole.items()} | {"length": length}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(t) for _, t, _ in examples]

    def vote(v, but=None):
        sims = ((sum(x * u.get(t, 0) for t, x in v.items()), i) for i, u in enumerate(vectors) if i != but)
        near = sorted(((round(s, 12), -i) for s, i in sims if s > 0), reverse=True)[:k]
        return (sum(s * examples[-i][2] for s, i in near) + prior_weight * n1 / n) / (prior_weight + sum(s for s, _ in near))

    model = tx.Model({}, [], {}, [], 0.0, n1 / n, k, prior_weight, rest)
    model.calibrate(np.array([vote(v, i) for i, v in enumerate(vectors)]), np.array([y for *_, y in examples]))
    return [model.score(vote(vector(t))) for t in texts]


def test_scores_match_brute_force(spark):
    rng = random.Random(6)
    say = lambda bad, n: " ".join(rng.choice(["vile", "foulness", "scums"]) if bad and rng.random() < 0.3 else f"w{int(rng.random() ** 3 * 80)}" for _ in range(n))
    rows = [(f"{i:04d}", say(i % 5 == 0, rng.randrange(3, 40)), int(i % 5 == 0)) for i in range(300)]
    model = tx.fit(spark.createDataFrame(rows, "doc_id string, text string, toxic int"))
    assert model.calibrated and model.words
    texts = [say(i % 3 == 0, rng.randrange(1, 60)) for i in range(60)] + ["", None, "entirely unknown words", rows[0][1], "vile"]
    got = {r.doc_id: r.score for r in tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], brute_scores(rows, texts), atol=1e-7)


def quality(spark, d):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(d + "/labels.parquet").collect()}
    rows = tx.op5_toxicity(spark, d).collect()
    out = [(r.predicted, truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    return rows, out


def test_held_out_rows(spark):
    rows, out = quality(spark, "/root/testdata/sf0.1")
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    wrong = sum(p != y for p, y, _ in out)
    print("held out", len(out), "wrong", wrong, "brier", np.mean([(s - y) ** 2 for _, y, s in out]))
    assert wrong / len(out) < 0.02


def test_odd_rows(spark):
    rows = [(i, "vile foul words" if i % 4 == 0 else f"kind words {i}", int(i % 4 == 0)) for i in range(80)]
    ex = spark.createDataFrame(rows + [(200, "x", None), (None, "kind", 0)], "doc_id long, text string, toxic int")
    model = tx.fit(ex)
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "vile foul", "s"), (3, "vile foul", "s"), (4, "kind " * 20000, "s")], "doc_id long, text string, toxic string")
    got = sorted((r.doc_id, r.predicted) for r in tx.score(docs, model).collect())
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert sorted(r.doc_id for r in tx.score(docs, model, keep="clean").collect()) == [1, 2, 4]
    none = tx.fit(ex.limit(0))
    assert all(r.score == 0 for r in tx.score(docs, none).collect())
    assert tx.score(docs.limit(0), model).count() == 0


def test_every_word_counts(spark):
    rare = [(1000 + i, f"slur{i} aimed at somebody{i}", 1) for i in range(5)]
    rows = [(i, "vile foul text" if i % 4 == 0 else f"kind text {i}", int(i % 4 == 0)) for i in range(80)]
    model = tx.fit(spark.createDataFrame(rows + rare, "doc_id long, text string, toxic int"))
    assert not any(w in model.words for _, t, _ in rare for w in tx.words_of(t))
    got = {r.doc_id: r.evidence for r in tx.score(spark.createDataFrame([x[:2] for x in rare] + [(2000, "a slur3 in other words")], "doc_id long, text string"), model).collect()}
    for i, _, _ in rare:
        assert got[i][0].example == str(i) and abs(got[i][0].similarity - 1) < 1e-9 and got[i][0].label == 1
    assert got[2000][0].example == "1003"


def test_repeated_words_are_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    known = Counting({b"one": 2, b"two": 0, b"red": 1})
    model = tx.Model({b"red": 0}, [1.5], known, [1.0, 2.0, 3.0], 4.0, 0.5, 5, 0.1, 1.5)
    terms, weights = model.vector("red two " * 50 + "one new new")
    assert known.asked == 4 and terms.tolist() == [0, 1, 2, 3, 4] and abs(weights @ weights) <= 1
    whole = np.array([2.0 * 0 + 1 + math.log(50), 2 * (1 + math.log(50)), 3.0])
    assert np.allclose(weights[1:4] / weights[3], whole / whole[2])
