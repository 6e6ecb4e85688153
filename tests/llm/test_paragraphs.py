import hashlib
import itertools
import random
import re

from siftline.llm import paragraphs as pg
from siftline.llm.decontaminate import words_of


def brute(docs, min_words, similarity=0.8):
    items = []
    for i, t in docs:
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            w = words_of(line)
            if len(w) >= min_words:
                sh = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
                items.append(((i is None, i or 0, k), (at, at + len(line)), sh))
            at += len(line) + 1
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(items)), 2):
        x, y = items[a][2], items[b][2]
        if len(x & y) >= similarity * len(x | y):
            p, q = find(a), find(b)
            if items[q][0] < items[p][0]:
                p, q = q, p
            parent[q] = p
    size = [sum(find(j) == find(i) for j in range(len(items))) for i in range(len(items))]
    return sorted((k, span, items[find(i)][0], items[find(i)][0] != k) for i, (k, span, _) in enumerate(items) if size[i] > 1)


def brute_windows(docs):
    """Equal windows of all texts by definition, as (place, span, keeper's place, removed)."""
    found = {}
    for i, t in docs:
        spans = [(m.start(), m.end()) for m in re.finditer("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        words = words_of(t)
        low = [int.from_bytes(hashlib.md5(w).digest()[:8], "little") % 2**30 for w in words]
        value = [sum(c * x for c, x in zip(pg._ANCHOR, low[j : j + 5], strict=True)) % (2**31 - 1) for j in range(len(words) - 4)]
        anchors = {min(range(s, s + pg.REACH), key=lambda j: (value[j], -j)) for s in range(len(value) - pg.REACH + 1)}
        for j in sorted(anchors):
            if j + pg.WINDOW <= len(words):
                found.setdefault(tuple(words[j : j + pg.WINDOW]), []).append(((i is None, i or 0, j), (spans[j][0], spans[j + pg.WINDOW - 1][1])))
    groups = [(min(same)[0], same) for same in found.values() if len({p[:2] for p, _ in same}) > 1]
    return sorted((place, span, first, place != first) for first, same in groups for place, span in same)


def got(df, kind="line"):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.para), (r.start, r.end), (r.keeper_doc is None, r.keeper_doc or 0, r.keeper_para), r.removed) for r in df.collect() if r.kind == kind)


def test_tuning():
    bands, rows = pg.tune_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def make():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("aeiou") * rng.randrange(1, 9) for _ in range(n))
    docs = []
    base = [say(60) for _ in range(4)]
    for i in range(60):
        words = rng.choice(base).split()
        if rng.random() < 0.7:
            words[rng.randrange(60)] = "x" + str(rng.randrange(99))
        docs.append((i, "\n".join([say(rng.randrange(1, 20)), ("É, " if i % 2 else "") + " ".join(words), say(15)])))
    same = say(30)
    docs += [(100 + i, f"{same}\n{say(12)}\n{same.upper()}") for i in range(30)]
    return docs + [(200, None), (201, ""), (202, "\n\n"), (None, same), (203, say(40))]


def test_classes_match_brute_force(spark):
    docs = make()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as h", "2 as component")
    assert got(pg.paragraph_classes(df, min_words=10)) == brute(docs, 10)
    left = {r.doc_id: r.text for r in pg.remove_repeats(df, min_words=10).collect()}
    assert left[200] is None and left[201] == "" and left[203] == docs[-1][1]
    assert len(left[100].split("\n")) == 2 and len(left[101].split("\n")) == 1


def test_large_groups_are_dealt_in_blocks(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(60)] = f"q{i}"
        docs.append((i, " ".join(w)))
    out = pg.paragraph_classes(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 'line'").collect()
    assert len(out) == 200 and {r.keeper_doc for r in out} == {0} and sum(r.removed for r in out) == 199


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(d + "/documents.parquet").collect()]
    out = pg.op6_paragraphs(spark, d)
    assert got(out) == brute(docs, pg.MIN_WORDS)
    assert got(out, "passage") == brute_windows(docs)
    assert pg.paragraph_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_chain_of_paragraphs_is_one_class(spark):
    words = [f"w{i}" for i in range(700)]
    docs = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = pg.paragraph_classes(df)
    assert got(out) == brute(docs, pg.MIN_WORDS)
    assert got(out, "passage") == brute_windows(docs)


def say(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + rng.choice("aeiou") * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(n))


def test_passages_are_found_wherever_they_stand(spark):
    """Fifty words in a row, inside a longer line or over short lines, always share a window."""
    rng = random.Random(3)
    docs = []
    for i in range(120):
        passage = say(rng, 50)
        docs.append((2 * i, f"{say(rng, rng.randrange(0, 200))} {passage} {say(rng, rng.randrange(0, 90))}"))
        broken = "\n".join(" ".join(passage.split()[k : k + 7]) for k in range(0, 50, 7)).upper()
        docs.append((2 * i + 1, f"Ünd. {say(rng, rng.randrange(0, 90))}\n{broken}, {say(rng, rng.randrange(0, 90))}"))
    docs += [(1000 + i, say(rng, 300)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = pg.paragraph_classes(df)
    assert {r.doc_id for r in out.collect()} == set(range(240))
    assert got(out, "passage") == brute_windows(docs)
    left = {r.doc_id: r.text for r in pg.remove_repeats(df).collect()}
    texts = dict(docs)
    assert all(left[d] == t for d, t in docs if d % 2 == 0 or d >= 1000)
    assert all(len(words_of(left[d])) <= len(words_of(texts[d])) - pg.WINDOW for d in range(1, 240, 2))


def test_rows_that_share_an_id_lose_nothing_else(spark):
    rng = random.Random(4)
    same, one, two = say(rng, 40), say(rng, 40), say(rng, 60)
    docs = [(1, same), (7, f"{same}\n{one}"), (7, two), (None, f"{two}\n{say(rng, 30)}"), (None, say(rng, 50)), (9, one), (9, one)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = sorted(map(repr, ((r.doc_id, r.text) for r in pg.remove_repeats(df).collect())))
    rest = docs[3][1].split("\n")[1]
    # rows equal in id and text act as one document
    assert left == sorted(map(repr, [(1, same), (7, one), (7, two), (None, rest), docs[4], (9, ""), (9, "")]))


def test_degenerate_texts(spark):
    docs = [(1, "word " * 300), (2, "word " * 300), (3, "a b " * 10_000), (4, "é " * 60), (5, "x"), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(pg.paragraph_classes(df), "passage") == brute_windows(docs)
    left = {r.doc_id: r.text for r in pg.remove_repeats(df).collect()}
    assert left[5] == "x" and left[6] is None and left[2] == "" and len(words_of(left[1])) >= pg.WINDOW
