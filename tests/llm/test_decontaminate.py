import hashlib
import random
import re

from siftline.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, window):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        w = WORD.findall(lower(item))
        if not w:
            continue
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                if name is not None:
                    found.add(str(name))
    return len(words), sorted(hit), sorted(found)


def cases(seed, vocab, window):
    random.seed(seed)
    say = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    items = [(i, say(random.randrange(0, 12))) for i in range(12)] + [(90, None), (91, ""), (None, say(8))]
    items += items[:3]
    texts = [say(random.randrange(0, 40)) for _ in range(60)] + [None, "", "?? !!"]
    texts += [f"{say(4)} {items[i][1]} {say(3)}" for i in range(8)]
    return items, texts


def test_scan_matches_brute_force():
    for seed in range(25):
        items, texts = cases(seed, ["a", "B", "é", "Ab", "b-a", "3"][: 2 + seed % 5], 4)
        auto = dc.Automaton([(None if n is None else str(n), dc.words_of(t)) for n, t in items], 4)
        for t in texts:
            spans, found = auto.scan(dc.words_of(t))
            n, hit, names = brute(t, items, 4)
            assert [x for s, e in spans for x in range(s, e)] == hit
            assert sorted(x for x in found if x is not None) == names
            assert len(dc.words_of(t)) == n


def test_blocks_give_the_same(spark):
    items, texts = cases(77, ["a", "B", "é"], 4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = dc.contamination(docs, bench, window=4).collect()
    many = dc.contamination(docs, bench, window=4, block_words=15).collect()
    assert sorted(one) == sorted(many)
    for r in one:
        n, hit, names = brute(texts[r.doc_id], items, 4)
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), names)


def test_removal(spark):
    item = "one two three four five"
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y", "k"), (2, "clean text", "k"), (3, None, None), (4, "Aa, " + item + "! " + "w " * 100, "k")], "doc_id long, text string, _marks string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r.doc_id: r.text for r in dc.remove_spans(docs, bench, window=4).collect()}
    assert got == {2: "clean text", 3: None, 4: "Aa, ! " + "w " * 100}
    both = bench.union(spark.createDataFrame([("r", "six seven eight nine ten eleven")], bench.schema))
    assert {r.doc_id: r.text for r in dc.remove_spans(docs, both, window=4, block_words=5).collect()} == got
    assert dc.remove_spans(docs, bench.limit(0)).count() == 4
    assert dc.remove_spans(docs.limit(0), bench).count() == 0


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(d + "/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(d + "/benchmark.parquet").collect()]
    for r in dc.op1_decontaminate(spark, d).collect():
        n, hit, names = brute(docs[r.doc_id], items, 13)
        assert (r.n_words, r.n_hit, r.n_items) == (n, len(hit), len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


def test_long_text(spark):
    item = " ".join(f"q{i}" for i in range(40))
    words = [f"w{i % 997}" for i in range(60_000)]
    words[50_000:50_040] = item.split()
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (2, "q1 q2")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item), ("b", "w1 w2 w3 w4")], "item_id string, text string")
    for block in (500_000, 10):
        rows = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in dc.contamination(docs, bench, block_words=block).collect())
        n, hit, _ = brute(" ".join(words), [("a", item), ("b", "w1 w2 w3 w4")], 13)
        assert rows == [(1, n, len(hit), ["a", "b"]), (2, 2, 0, []), (2, n, len(hit), ["a", "b"])]
