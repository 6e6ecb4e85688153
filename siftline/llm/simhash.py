"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.
Seven bit masks are built from the nonzero vectors m of {0,1}^3, dealt over the
64 bit positions: mask v keeps the positions whose <m, v> is odd.  Any two
positions leave some v orthogonal to both of their vectors, so two fingerprints
that differ in at most two bits agree on all kept bits of some mask (a covering
family for radius 2: no false negatives).

Within a bucket (a mask and its kept bits) links are found without listing the
pairs of a large group.  A bucket of a few fingerprints is compared directly.  In
a larger one every fingerprint is sent to the 65 points at distance 0 or 1; two
fingerprints within distance 2 share such a point, and all that share one are
within distance 2 of each other, so each is linked to the smallest there.  The
work is linear in the bucket, exact, and yields the same components.

Edge cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer than ``size`` words make one shingle; equal
rows share a class; a null id stays in the result, links, and never names a class
(one without any id has none); rows that repeat an id are told apart by their
texts, and of rows equal in id and text one stays; an empty table gives an empty
result; other columns are ignored, or kept by ``simhash_dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.storage import scratch, stored
from .columns import free_name

BITS = 64
SEED = 42
#: A bucket of at most so many fingerprints is compared pair by pair.
DIRECT = 24
_CHUNK = 1 << 16


def fingerprint_text(text: str | None, size: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), SEED)
    counts, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        shingles = zip(*(part[i:] for i in range(size)), strict=False)
        h = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, row, fp``: the fingerprint of every row, as a signed 64-bit integer; ``row`` tells rows of one id apart by their texts."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint_text(t.as_py(), size) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def covering_masks(radius: int = 2) -> list[int]:
    """Signed 64-bit masks of which, for any ``radius`` positions, one keeps none."""
    dims = radius + 1
    vectors = range(1, 1 << dims)
    masks = []
    for v in vectors:
        kept = sum(1 << i for i in range(BITS) if ((1 + i % len(vectors)) & v).bit_count() % 2)
        masks.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return masks


def _links(points: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp``; their components are those of all links."""
    if radius != 2:
        raise ValueError("links in large buckets are built for radius 2")
    tables = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)))
    keyed = points.select("fp", F.posexplode(tables).alias("v", "key"))
    full = stored(keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    hits = stored(keyed.join(full, ["v", "key"]), "bucketed")
    small = hits.where(F.col("n") <= DIRECT).groupBy("v", "key").agg(F.array_sort(F.collect_list("fp")).alias("g"))
    near = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= radius)), lambda y: F.struct(y.alias("a"), x.alias("b")))))
    direct = small.select(F.explode(near).alias("e")).select("e.*")
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < BITS - 1 else -(1 << i))) for i in range(BITS)))
    ball = hits.where(F.col("n") > DIRECT).select("fp").distinct().select("fp", F.explode(flips).alias("z"))
    # at most 65 distinct fingerprints lie within one bit of z
    shared = ball.groupBy("z").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    through = shared.select(F.explode("fps").alias("a"), "b").where("a <> b")
    return direct.unionByName(through).distinct()


def _classes(digest: DataFrame, radius: int) -> DataFrame:
    """``fp, component_id, keeper``: of every fingerprint its class, the smallest id there and the row that stays."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    points = stored(digest.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min(first).alias("first")), "points")
    label = connected_components(_links(points.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    named = stored(points.join(label, "fp", "left").select("fp", "id", "first", F.coalesce("component", "fp").alias("component")), "named")
    classes = named.groupBy("component").agg(F.min("id").alias("component_id"), F.min("first").alias("first"))
    return named.select("fp", "component").join(classes, "component").select("fp", "component_id", F.col("first.row").alias("keeper"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``: every row with its fingerprint and the smallest id reachable by links."""
    with scratch() as keep:
        digest = keep(stored(fingerprints(docs, id_col, text_col, size), "fingerprints"))
        classes = keep(stored(_classes(digest, radius), "classes"))
        return digest.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> "F.Column":
    """16 lowercase hexadecimal digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one row, that with the smallest id (rows without id come last, ties go by a hash of the text)."""
    row = free_name(docs, "row")
    with scratch() as keep:
        digest = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
        kept = keep(stored(_classes(digest, radius).select(F.col("keeper").alias("_keeper")).distinct(), "kept"))
        twins = digest.join(kept, digest["row"] == kept["_keeper"], "left_semi").count() > kept.count()
        out = docs.withColumn(row, _row(id_col, text_col)).join(kept, F.col(row) == F.col("_keeper"), "left_semi")
        return (out.dropDuplicates([row]) if twins else out).drop(row)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
