"""Sharding by sampled splitters: range partition with near-equal bytes.

Rows are ordered by (hash of the text, id): equal texts are neighbours, and an
order that says nothing about size or source spreads both.  A size-weighted
sample of the keys is drawn (a row of size s is taken with probability
proportional to s, by a hash of its key, so the draw repeats); its quantiles are
the splitters of many small ranges.  The exact bytes of each range give every
range its place; a range that holds a shard's end, however full, is subdivided at
the byte by a running sum within it.  So shard sizes differ by less than two
rows' sizes.  Keys are unique to the row, so a hot text is split over as many
ranges as its size asks for.

The law is ``bytes``.  Splitters are a bounded table (at most ``shards *
ranges_per_shard`` rows); everything else stays in joins and windows within one
range.  DataFrame functions only.

Edge cases: size is the text's UTF-8 bytes plus 8 (a null text has none, and the
checksum of no bytes); null ids sort first; repeated rows are told apart by a row
number and each get a slot; fewer rows than shards leave shards empty; an empty
table gives an empty result; other columns are kept by ``shard``, and one named
like a result column gets underscores at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .columns import make_room

OVERHEAD = 8
_PREFIX_BITS = 12
#: Sampled keys per range: the relative error of a range's bytes is about 1/sqrt of this.
_PER_RANGE = 40


def _digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row its key (h, id, tie), size and checksum, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )


def _key(prefix: str = "") -> "F.Column":
    return F.struct(*(F.col(prefix + c) for c in ("h", "doc_id", "tie")))


def _splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """``cell, key``: the first keys of ranges 1.. , quantiles of a size-weighted sample."""
    wanted = ranges * _PER_RANGE
    draw = (F.xxhash64("tie", "doc_id", "h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    sample = rows.where(draw < F.col("size") * (wanted / total)).select(_key().alias("key"))
    # the sample is bounded by its rate, so one task may number it
    place = F.row_number().over(Window.orderBy("key"))
    numbered = sample.select("key", place.alias("i")).crossJoin(F.broadcast(sample.agg(F.count("*").alias("n"))))
    cell = F.floor(F.col("i") * ranges / (F.col("n") + 1))
    return numbered.select("key", cell.cast("int").alias("cell")).where("cell > 0").groupBy("cell").agg(F.min("key").alias("key"))


def _cells(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """``rows`` with the number of splitters at or before each key, through a table of hash prefixes."""
    prefix = lambda h: F.shiftright(h, 64 - _PREFIX_BITS) + (1 << (_PREFIX_BITS - 1))
    spark = rows.sparkSession
    inside = splitters.groupBy(prefix(F.col("key.h")).alias("p")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    every = spark.range(1 << _PREFIX_BITS).select(F.col("id").alias("p")).join(F.broadcast(inside), "p", "left")
    n = F.when(F.col("keys").isNull(), 0).otherwise(F.size("keys"))
    before = F.coalesce(F.sum(n).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = every.select("p", F.col("keys"), before.alias("before"))
    joined = rows.withColumn("p", prefix(F.col("h"))).join(F.broadcast(table), "p")
    within = F.when(F.col("keys").isNull(), 0).otherwise(F.size(F.filter("keys", lambda k: k <= _key())))
    return joined.withColumn("cell", (F.col("before") + within).cast("int")).drop("p", "keys", "before")


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, h, tie`` for every row."""
    rows = stored(_digest(docs, id_col, text_col), "keys")
    total = rows.agg(F.sum("size")).first()[0]
    ranges = shards * ranges_per_shard
    celled = _cells(rows, _splitters(rows, total, ranges)) if total else rows.withColumn("cell", F.lit(0))
    celled = stored(celled, "ranges")
    # a bounded table: what lies before each range
    sums = celled.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("cell", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("cell").orderBy("h", "doc_id", "tie")
    running = celled.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).alias("nth"))
    placed = running.join(F.broadcast(offsets), "cell")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(total or 1)))).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", "h", "tie", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("rank")), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # at most one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"), "h", "tie")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows of ``docs`` with their shard and their place in it."""
    docs = make_room(docs, shard_col, slot_col)
    placed = assign(docs, shards, id_col, text_col).select(F.col("h").alias("_h"), F.col("doc_id").alias("_id"), F.col("shard").alias(shard_col), F.col("slot").alias(slot_col), "tie")
    # rows with equal text and id are interchangeable: the k-th of them takes the k-th place
    twin = Window.partitionBy("_h", "_id").orderBy("tie")
    placed = placed.withColumn("_k", F.row_number().over(twin)).drop("tie")
    names = docs.columns
    named = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(id_col).alias("_id"))
    if placed.where("_k > 1").limit(1).count():
        same = Window.partitionBy("_h", "_id").orderBy(F.monotonically_increasing_id())
        named = named.withColumn("_k", F.row_number().over(same))
    else:
        named = named.withColumn("_k", F.lit(1))
    match = (named["_h"] == placed["_h"]) & named["_id"].eqNullSafe(placed["_id"]) & (named["_k"] == placed["_k"])
    return named.join(placed, match).select(*(F.col("_row")[c].alias(c) for c in names), shard_col, slot_col)


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder a shard, rows by slot."""
    out = shard(docs, shards, id_col, text_col)
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = assign(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
