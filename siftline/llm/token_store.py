"""Token ids in ORC: one row a document, run-length encoded, prunable by document id.

Documents are range-partitioned by id and sorted, so file k holds ids below those
of file k+1 and a reader can take files and stripes in parallel.  Ids are an ORC
``array<int>``, which the writer run-length encodes; row indexes carry minima and
maxima of ``doc_id`` for groups of rows, and Bloom filters on ``doc_id`` let a
point lookup skip stripes.  Each row also carries its file's number and its place in
the file, so offsets in the whole stream need one small sum over files.

A chunk between spaces, tabs and line ends is tokenised alike wherever it stands
(the tokeniser drops white space and never joins across it), and so is a run of
letters in a text of plain characters.  Ids of such pieces are kept in a bounded
cache; what it lacks goes to the tokenizers library.  This holds for tokenisers
that lower case and that split letters from the rest, as word_bpe_49k.json does.

Edge cases: a null text counts as empty and has the end id only; null ids come
first; repeated rows each get a row, equal ids in order of a hash of their text (so
that rows of one id need not stand in one file); an empty
table writes no rows and reads back empty; other columns are not stored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import new_path, stored

SCHEMA = "doc_id long, ids array<int>, file int, place long"
#: What the tokeniser never joins: chunks between white space and, in plain texts, runs of letters and of other characters.
_CHUNKS = re.compile(r"[^ \t\n\r]+")
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^ \t\n\ra-zß-öø-ÿ]+")
#: Texts with other characters than these aren't plain: their letters may combine, change by case or make contractions.
_PLAIN = bytes(c for c in range(256) if c in b" \t\n\r" or 0x21 <= c <= 0x7E and c != 0x27 or c >= 0xC0 and c not in (0xD7, 0xF7))
_WORD = re.compile(r"[a-zß-öø-ÿ]+")
#: Characters a task encodes at a time, and pieces it keeps ids of.
_BATCH_CHARS = 1 << 20
_CACHE = 600_000
WORD_END = "</w>"


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class Encoder:
    """Encodes whole texts with a tokenizers file, keeping the ids of pieces seen before."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")
        self.cache: dict[str, bytes] = {}
        size = self.tok.get_vocab_size()
        ends = np.array([(self.tok.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])
        #: Tokens that end a word; without such a mark words are encoded one by one.
        self.ends = ends if ends.any() else None

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of the pieces into the cache; words go many to a call."""
        words = [w for w in pieces if _WORD.fullmatch(w)] if self.ends is not None else []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokeniser does not mark each word's end once")
            raw = ids.tobytes()
            self.cache.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        rest = [w for w in pieces if w not in self.cache] if words else pieces
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            self.cache.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_RUNS.findall(t.lower()) if _is_plain(t) else _CHUNKS.findall(t) for t in (x or "" for x in texts)]
        cache = self.cache
        new = {c for pieces in split for c in pieces if c not in cache}
        if len(cache) + len(new) > _CACHE:
            cache.clear()
            new = {c for pieces in split for c in pieces}
        self._learn(list(new))
        ids_of = cache.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, pieces)) + self.end, "<i4") for pieces in split]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int | None) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path, end_id)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, stripe_mb: int = 64, index_rows: int = 10_000) -> None:
    """Encode every text and write the ORC files; ``tokenizer`` is a tokenizers JSON file on every node."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        encoder, number, done = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column(1)
            size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0))))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + _BATCH_CHARS, "right")) - 1)
                ids = encoder.encode(texts[at:to].to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.record_batch([b.column(0)[at:to], lists, pa.array(np.full(to - at, number, np.int32)), pa.array(np.arange(done, done + to - at))], names=["doc_id", "ids", "file", "place"])
                done += to - at
                at = to

    (
        placed.mapInArrow(run, SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(index_rows)).option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "zstd").orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids, file, place`` as written; filters on doc_id prune stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents read by ``read_tokens``."""

    def run(batches):
        for b in batches:
            ids = b.column(1)
            ends = np.asarray(ids.offsets)
            raw = np.asarray(ids.values, dtype="<u4")
            crc = [zlib.crc32(raw[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    rows = stored(tokens.select("doc_id", "ids", "file", "place").mapInArrow(run, "doc_id long, file int, place long, n_tokens long, ids_crc32 long"), "index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    # one row a file: a number the writer fixed
    placed = rows.withColumn("upto", upto).join(F.broadcast(files), "file")
    return placed.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_store(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return token_index(read_tokens(spark, path))
