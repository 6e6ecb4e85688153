import zlib

import numpy as np
import public_tokenizers
from siftline.llm import token_store as ts
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def expect(docs):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_chunks_encode_as_whole_texts():
    odd = ["It's we'll  don't", " ́é é ́x", "a b\x85c\x1cd﻿e", "ΑΣ ΑΣ. İ ǅ", "12 345\t<|endoftext|> 6", "", None, "  x", "日本 語\r\nが ｶ", "A" * 5000, "x​y ퟿", "ᄀ ᅡ 가"]
    odd += ["ÉÀ café, x-y_z (a1b22c) ß ÿ Ø! a|b `q` ~", "e\u0301 Éa", "naïve don't x", "<|startoftext|>a<|endoftext|>", "Ǆ ĳ ŉ x", "µ ª º 1º", "ﬁ ﬂ", "a×b÷c"]
    tok = Tokenizer.from_file(PATH)
    for t, ids in zip(odd, ts.Encoder(PATH, None).encode(odd), strict=True):
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_round_trip(spark):
    docs = [(9, "Some text"), (-4, None), (3, ""), (100, "more TEXT here\n" * 40), (None, "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as file", "2 as ids")
    path = ts.new_path(spark, "t")
    ts.write_tokens(df, path, PATH, partitions=3)
    got = [tuple(r) for r in ts.token_index(ts.read_tokens(spark, path)).orderBy("start").collect()]
    assert got == expect(docs)
    found = ts.read_tokens(spark, path).where("doc_id = 9").collect()
    assert found[0].ids == Tokenizer.from_file(PATH).encode("Some text", add_special_tokens=False).ids + [2]


def test_repeated_ids_start_where_the_file_has_them(spark):
    docs = [(1, f"text number {i} " * (i % 7 + 1)) for i in range(60)] + [(None, f"t {i}") for i in range(9)] + [(1, "same")] * 3 + [(0, "x"), (2, None)]
    path = ts.new_path(spark, "t")
    ts.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), path, PATH, partitions=4)
    tokens = ts.read_tokens(spark, path)
    assert tokens.where("doc_id = 1").select("file").distinct().count() > 1
    stream, at = [i for r in sorted(tokens.collect(), key=lambda r: (r.file, r.place)) for i in r.ids], 0
    rows = ts.token_index(tokens).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    for r in rows:
        ids = stream[at : at + r.n_tokens]
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += r.n_tokens


def test_files_have_indexes_and_bloom_filters(spark):
    path = ts.new_path(spark, "t")
    df = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    ts.write_tokens(df, path, PATH, partitions=2, index_rows=1000)
    file = ts.read_tokens(spark, path).inputFiles()[0]
    orc, conf = spark._jvm.org.apache.orc.OrcFile, spark.sparkContext._jsc.hadoopConfiguration()
    reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(conf))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {s.getKind().toString() for s in footer.getStreamsList() if s.getColumn() == 1}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds and reader.getRowIndexStride() == 1000
    assert footer.getColumnsList()[3].getKind().toString() == "DIRECT_V2"
    plan = ts.read_tokens(spark, path).where("doc_id = 77")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,77)" in plan


def test_empty_table(spark):
    path = ts.new_path(spark, "t")
    ts.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert ts.token_index(ts.read_tokens(spark, path)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(d + "/documents.parquet").collect()]
    got = [tuple(r) for r in ts.op7_token_store(spark, d).orderBy("start").collect()]
    assert got == expect(docs)
