"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return a DataFrame.

toxicity        documents predicted toxic go
simhash         of each group of near duplicates one document stays
decontaminate   contaminated documents go, smaller benchmark passages are cut out
mixing          junk is thinned to its target share; prose stays
shard           every document gets a shard and a slot

Edge cases: null and empty texts are clean, form one group of near duplicates (of
which the row with the smallest id stays) and are never thinned; rows that repeat an id are
told apart by their texts, and of rows equal in both one stays; null ids come last in
their group; an empty table passes through; other columns are carried, and those
named ``shard`` or ``slot`` get underscores at their end in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, mixing, shard, simhash, toxicity
from siftline.plans.storage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep="clean")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_spans(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("toxic = 0 or toxic is null")
    known = mixing.labelled_documents(docs, labels)
    return mixing.mix(docs, known, targets={"prose": 0.92, "junk": 0.08}, protect="prose")


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard.shard(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", near_duplicates),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_sources),
    ("shard", to_shards),
]

#: Nearest neighbours, components and fitted rates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
