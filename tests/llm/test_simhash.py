import itertools
import random

import xxhash
from siftline.llm import simhash


def slow_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_definition():
    for t in [None, "", " \n", "One", "One TWO", "a b c", "É é x y Z z z z z\x0bq", "a b c a b c a b d " * 30]:
        assert simhash.fingerprint_text(t) == slow_fingerprint(t)


def test_masks_cover_every_pair_of_positions():
    masks = [m % 2**64 for m in simhash.covering_masks()]
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def groups_of(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_links_match_brute_force(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(4)]
    fps = list(dict.fromkeys([*base, *(random.choice(base) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (random.randrange(2) << random.randrange(64)) for _ in range(300))]))
    fps = sorted(fps, key=lambda f: f - (f >> 63 << 64))
    rows = [(f - (f >> 63 << 64),) for f in fps]
    from siftline.operators.graph import connected_components

    edges = simhash._links(spark.createDataFrame(rows, "fp long"), 2).collect()
    assert all(((e.a ^ e.b) % 2**64).bit_count() <= 2 for e in edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert [got.get(f, f) for f, in rows] == [rows[i][0] for i in groups_of(fps)]


def test_rows_nulls_and_repeats(spark):
    rows = [(5, "a b c d", "x"), (2, "a b c d", None), (2, "a b c d", "y"), (9, None, "z"), (8, "", "z"), (None, "q r s", "w"), (3, "other words stand here", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == {(5, 2), (2, 2), (9, 8), (8, 8), (None, None), (3, 3)}
    kept = [r.doc_id for r in simhash.simhash_dedup(docs).collect()]
    assert sorted(kept, key=str) == [2, 3, 8, None]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "one text that stands alone", "a"), (1, "quite another text without likeness", "b"), (2, "one text that stands alone", "c"), (3, "third", "d"), (3, "third", "e"), (None, "no id here", "f"), (None, "no id at all", "g"), (None, "third", "h"), (None, "no id here", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted((str(r.doc_id), r.text) for r in simhash.simhash_dedup(docs).collect())
    assert kept == [("1", rows[0][1]), ("1", rows[1][1]), ("3", "third"), ("None", "no id at all"), ("None", "no id here")]
    assert simhash.simhash_dedup(docs).columns == docs.columns


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(d + "/documents.parquet").collect())
    fps = [slow_fingerprint(t) for _, t in texts]
    want = {i: (f"{f:016x}", texts[g][0]) for (i, _), f, g in zip(texts, fps, groups_of(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, d).collect()}
    assert got == want


def test_long_text(spark):
    words = [f"w{i * i % 977}" for i in range(70_000)]  # beyond one chunk of shingles
    assert simhash.fingerprint_text(" ".join(words)) == slow_fingerprint(" ".join(words))
