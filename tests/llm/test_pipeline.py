from collections import Counter

import corpus_pipeline as cp
from siftline.llm import decontaminate, simhash
from siftline.plans.storage import stored

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(D + "/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, D), name)
        after[name] = docs.collect()
        if name != "shard":
            assert docs.columns == columns
    ids = {k: [r.doc_id for r in v] for k, v in after.items()}
    assert set(ids["simhash"]) <= set(ids["toxicity"]) and set(ids["decontaminate"]) <= set(ids["simhash"])
    # one document of each group of near duplicates, by brute force
    fps = {i: simhash.fingerprint_text(texts[i]) for i in ids["toxicity"]}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and group[b] < group[a]:
                    group[a], changed = group[b], True
    assert sorted(ids["simhash"]) == sorted(set(group.values()))
    bench = decontaminate.Automaton([(str(r.item_id), decontaminate.words_of(r.text)) for r in spark.read.parquet(D + "/benchmark.parquet").collect()], 13)
    for r in after["decontaminate"]:
        spans, _ = bench.scan(decontaminate.words_of(texts[r.doc_id]))
        assert 20 * sum(e - s for s, e in spans) < max(1, len(decontaminate.words_of(texts[r.doc_id])))
    assert Counter(ids["shard"]) == Counter(ids["mixing"])
    assert all(0 <= r.shard < 24 for r in after["shard"])


def test_run(spark):
    out = cp.run(spark, D)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 50


def test_stages_on_odd_rows(spark):
    """Null, empty and very long texts, repeated and null ids, equal rows, and columns named like results."""
    docs = spark.read.parquet(D + "/documents.parquet")
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(30_000))
    prose = [r.text for r in docs.where("n_chars between 1500 and 4000").orderBy("doc_id").limit(3).collect()]
    said = lambda k: " ".join(f"{w}{k}" for w in prose[k].split())
    odd = [(5_000_000, None), (5_000_001, ""), (5_000_002, " \n "), (0, said(0)), (5_000_003, said(1)), (5_000_003, said(1)), (5_000_004, long), (None, said(2)), (None, said(0) + " " + said(2))]
    extra = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in odd], docs.schema)
    docs = docs.unionByName(extra)
    for c in ("score", "row", "shard", "spans", "marks", "key"):
        docs = docs.withColumn(c, docs["doc_id"].cast("string"))
    columns, after = docs.columns, []
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, D), name)
        if name != "shard":
            assert docs.columns == columns
        after.append((name, {(r.doc_id, r.text) for r in docs.collect()}, docs.count()))
    wanted = {(0, said(0)), (5_000_003, said(1)), (5_000_004, long), (None, said(2)), (None, said(0) + " " + said(2))}
    for name, kept, n in after:
        assert wanted <= kept, name
        if name != "toxicity":  # equal rows and the texts without words are one group each
            assert n == len(kept) and len(kept & {(i, t) for i, t in odd[:3]}) <= 1
    assert after[-1][2] == after[-2][2] and set(docs.columns) >= {"shard", "slot", "shard_"}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(D + "/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, D), name)
        assert docs.count() == 0
