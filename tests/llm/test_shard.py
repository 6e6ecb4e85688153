import random
import zlib
from collections import Counter, defaultdict

from siftline.llm import shard as sh


def check(rows, docs, shards, slack=None):
    sizes = Counter()
    slots = defaultdict(list)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for r in rows:
        assert 0 <= r.shard < shards
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if rows:
        per = sum(sizes.values()) / shards
        assert all(abs(sizes[s] - per) <= 2 * max(len((t or "").encode()) + 8 for _, t in docs) for s in range(shards))


def test_bytes_are_even_with_a_hot_text(spark):
    random.seed(1)
    docs = [(i, "same text again") for i in range(400)] + [(1000 + i, "x" * random.randrange(60)) for i in range(600)] + [(7, None), (None, "é"), (None, "é"), (3, "same text again"), (3, "same text again")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(sh.assign(df, 6).collect(), docs, 6)
    out = sh.shard(df.selectExpr("doc_id", "text", "'k' as h"), 6).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(docs)
    assert len({(r.shard, r.slot) for r in out}) == len(docs)


def test_small_and_empty(spark):
    docs = [(1, "a"), (2, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(sh.assign(df, 24).collect(), docs, 24)
    assert sh.assign(df.limit(0), 24).count() == 0
    assert sh.shard(df.limit(0), 24).count() == 0
    assert sh.shard(df.withColumn("Slot", df.doc_id), 4).columns == ["doc_id", "text", "Slot_", "shard", "slot"]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(d + "/documents.parquet").collect()]
    rows = sh.op8_shard(spark, d).collect()
    check(rows, docs, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
