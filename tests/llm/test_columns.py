"""Clashing column names in every operator that carries columns."""

from siftline.llm import decontaminate, language, mixing, paragraphs, shard, simhash, toxicity

NAMES = ["score", "predicted", "evidence", "lang_pred", "languages", "shard", "slot", "h", "tie", "size", "row", "component_id", "fp", "_id", "_copies", "copy", "_k", "_h", "_row", "_marks", "spans", "items", "bucket", "w", "p", "rate", "copies", "_gone", "_gone_id", "n", "y", "name", "_keep_id", "draw", "cell"]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words to stand here"), (2, "other words"), (3, None)], "doc_id long, text string")
    wide = docs.selectExpr("*", *(f"'{n}' as `{n}`" for n in NAMES), "'en' as lang", "1 as toxic", "1 as quality")
    empty = toxicity.fit(wide.limit(0))
    assert toxicity.score(wide, empty).where("score_ = 'score' and score = 0").count() == 3
    assert toxicity.score(wide, empty, keep="clean").columns == wide.columns
    model = language.fit(wide)
    assert language.identify(wide, model).where("score_ = 'score' and lang_pred = 'en'").count() == 2
    assert simhash.simhash_groups(wide).count() == 3 and simhash.simhash_dedup(wide).columns == wide.columns
    bench = spark.createDataFrame([(1, "q r s")], "item_id long, text string")
    assert decontaminate.remove_spans(wide, bench).columns == wide.columns and decontaminate.contamination(wide, bench).count() == 3
    known = spark.createDataFrame([(1, "a b", "x"), (2, "c d", "y")], "doc_id long, text string, domain string")
    assert mixing.rates(wide, known, {"x": 0.5, "y": 0.5}).count() == 3
    assert mixing.mix(wide, known, targets={"x": 0.5, "y": 0.5}, ceiling=1.0).columns == wide.columns
    assert shard.shard(wide, 3).where("shard_ = 'shard' and slot_ = 'slot' and h = 'h'").count() == 3
    assert paragraphs.remove_repeats(wide, min_words=2).columns == wide.columns
