import hashlib
import re

from siftline.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    out = [(m.start(), list(RULES).index(k), m.end(), k) for k, r in RULES.items() for m in re.finditer(r, text or "") if valid(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


ODD = [
    None, "", "no data", "a@b.c d_e@f-g.h.i,j@k x@y.z_w@v.u", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111-", "+1 (612) 555-4887 +12345678 ++12 345 678 90 +1..........2 +123456789012345678",
    "é@x.y ü4111111111111111ü 😀 10.0.0.1😀 a@b.c", "1" * 30000, "1 " * 30000, "a" * 50000, "a@" * 20000, "a.b@c" + ".d" * 20000, "+1" * 20000, "+" + "1-" * 20000, "1." * 20000,
    "%@a.b -@-.- .@.a a@b..c a@b.c@d.e", "0000000000000000 000000000000", "x\n+1 415\n555 2671", "4111 1111  1111 1111",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "y"), (None, ODD[4], "z")], "doc_id long, text string, row string")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = ODD[4] if r.doc_id is None else ODD[r.doc_id]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.base] == brute(text), (text or "")[:60]
        assert all(s.value == text[s.start : s.end] for s in r.base)


def test_contexts_discover_unseen_identifiers(spark):
    docs = [(i, f"some words then dial +1 (612) 555-{1000 + i} now") for i in range(30)]
    docs += [(100 + i, f"some words then dial 612.555.{2000 + i} now") for i in range(3)]
    docs += [(200 + i, f"words and reach 612.555.{2000 + i % 3} later" if i < 6 else "then other words x99999 stand") for i in range(30)]
    docs += [(300, "please reach x55555, ok")]
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), support=3).collect()}
    assert [(s.kind, s.value) for s in rows[101].added] == [("phone", "612.555.2001")]
    assert [s.value for s in rows[300].added] == ["x55555"]  # by a pattern learnt from what the first one found
    assert not rows[220].added and not rows[3].added


def test_contexts_find_a_kind_without_a_rule(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:40]
    docs = [(i, f"some words token  = \"{digest(i)}\" more") for i in range(40)]
    docs += [(100 + i, f"as seen in TOKEN = short{i}x!! yes") for i in range(3)]
    docs += [(200 + i, f"in {'these' if i % 2 else 'other'} words {digest(1000 + i) if i < 8 else 'nothing'} stands") for i in range(60)]
    docs += [(300, "token = 4111111111111112 refused"), (301, "token = a@b.cd"), (302, "a token of thanks, token = none")]
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(40):
        assert [(s.kind, s.value, docs[i][1][s.start : s.end]) for s in rows[i].added] == [("secret", digest(i), digest(i))], i
    assert [s.value for s in rows[101].added] == ["short1x"]  # no shape, but the context
    assert not any(rows[i].added for i in [*range(200, 260), 300, 301, 302])  # a long token behind a word like any other isn't one
    assert [s.kind for s in rows[301].base] == ["email"]


def test_added_spans_on_the_test_tables(spark):
    """All added spans stand behind the one context that the tables repeat, and nearly all of its identifiers are found."""
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(d + "/documents.parquet").collect()}
    found = {(r.doc_id, s.start, s.end) for r in pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect() for s in r.added}
    truth = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert truth and found == truth


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(d + "/documents.parquet").collect()}
    rows = pii.op3_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))  | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in RULES]
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
