import numpy as np
from siftline.llm import language as lg


def brute_grams(text):
    from collections import Counter

    raw = b" " + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode().lower()) + b" "
    n = Counter()
    for i in range(len(raw) - 2):
        if raw[i + 1] != 32:
            code = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
            n[(code * 2654435761 % 2**32) >> 16] += 1
    return n


def test_grams():
    for t in ["", "a", "Ab, cé 3x", "word " * 50]:
        where, n = lg.grams(t)
        assert dict(zip(where.tolist(), n.tolist(), strict=True)) == brute_grams(t)


def test_mixture_finds_the_likeliest_proportions():
    rng = np.random.default_rng(1)
    likely, counts = rng.dirichlet(np.ones(20), 2).T, rng.integers(1, 9, 20).astype(float)
    share, top = lg.mixture(likely, counts, steps=2000, tolerance=1e-9)
    grid = [float(counts @ np.log(likely @ [x, 1 - x])) for x in np.linspace(1e-6, 1 - 1e-6, 4001)]
    assert top >= max(grid) - 1e-6


def test_held_out_accuracy_and_mixtures(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(d + "/documents.parquet").collect()}
    rows = lg.op4_language(spark, d).collect()
    out = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in out)
    print("held out", len(out), "right", right, [(truth[r.doc_id][0], r.lang_pred, truth[r.doc_id][1][:90]) for r in out if r.lang_pred != truth[r.doc_id][0]])
    assert right / len(out) > 0.97 and len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    docs = spark.read.parquet(d + "/documents.parquet")
    model = lg.fit(docs)
    a = next(t for x, t in truth.values() if x == "de" and 2000 < len(t) < 5000)
    b = next(t for x, t in truth.values() if x == "fr" and 2000 < len(t) < 5000)
    both = model.select(a[:2000] + "\n" + b[:1000])
    assert [x for x, _ in both] == ["de", "fr"] and 0.5 < both[0][1] < 0.85


def test_odd_rows(spark):
    ex = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    model = lg.fit(ex)
    assert model.languages == ["en", "fr"]
    docs = spark.createDataFrame([(1, None), (2, "123 !!"), (3, "the dog"), (3, "the dog"), (None, "le chien"), (5, "the cat and " * 30000)], "lang long, text string")
    got = sorted(((r.lang or 0, r.lang_pred) for r in lg.identify(docs, model).collect()))
    assert got == [(0, "fr"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (5, "en")]
    assert {r.lang_pred for r in lg.identify(docs, lg.fit(ex.limit(0))).collect()} == {"und"}
    assert lg.identify(docs.limit(0), model).count() == 0


def brute_select(model, text):
    """The chosen set by trying every language at every step, each mixture by plain loops."""
    import math

    n = brute_grams(text)
    if not n or not any(c.isalpha() for c in text):
        return []

    def fit(chosen):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(400):
            new = [0.0] * len(chosen)
            for b, c in n.items():
                at = [s * model.likely[b, i] for s, i in zip(share, chosen, strict=True)]
                for j, x in enumerate(at):
                    new[j] += c * x / sum(at)
            share = [x / sum(n.values()) for x in new]
        return share, sum(c * math.log(sum(s * model.likely[b, i] for s, i in zip(share, chosen, strict=True))) for b, c in n.items())

    bar = 3 * model.penalty * math.log(sum(n.values()) / 3 + 2)
    every, chosen, best = range(len(model.languages)), [], -math.inf
    while len(chosen) < len(model.languages):
        gain, i = max((fit([*chosen, i])[1], -i) for i in every if i not in chosen)
        if chosen and gain - best <= bar:
            break
        chosen, best = [*chosen, -i], gain
    return sorted(((model.languages[i], s) for i, s in zip(chosen, fit(chosen)[0], strict=True)), key=lambda x: (-x[1], x[0]))


def test_selection_matches_brute_force(spark):
    import random

    d = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(d + "/documents.parquet").collect() if r.text]
    model = lg.fit(spark.read.parquet(d + "/documents.parquet"))
    rng = random.Random(5)
    by = {x: [t for y, t in rows if y == x and len(t) > 400] for x in model.languages}
    texts = [rng.choice(rows)[1][:600] for _ in range(12)]
    texts += [rng.choice(by[a])[: rng.randrange(100, 400)] + " " + rng.choice(by[b])[: rng.randrange(100, 400)] for a in model.languages for b in model.languages if a < b]
    several = 0
    for t in [*texts, "a", "12 !", "é"]:
        got, want = model.select(t), brute_select(model, t)
        several += len(want) > 1
        assert {x for x, _ in got} == {x for x, _ in want}, t[:80]
        assert np.allclose([s for _, s in sorted(got)], [s for _, s in sorted(want)], atol=0.02)
    assert several >= 3
