"""Language identification by mixture inference.

Every language has a distribution over hashed letter n-grams, learnt from labelled
rows.  A document is taken as a mixture of languages: expectation-maximisation
finds the proportions under which its n-grams are likeliest.  Which languages it
holds is chosen by penalised likelihood: from the best single language, the
language that adds most is taken in as long as the gain exceeds a penalty that
grows with the log of the document's size.  The document's language is the one
with the largest proportion.

N-grams are three bytes of the UTF-8 text with A-Z lower-cased and everything but
letters and bytes beyond ASCII as a space; grams around a space in the middle are
left out.  Whole texts are read.

The model is a bounded table (2^16 rows, one column a language); it learns from
at most ``per_language`` rows of a language in expectation, by a hash of the id.
Every document is predicted in one pass without a shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is
every text if no row is labelled; null languages and null texts teach nothing;
repeated rows are predicted alike; ties go to the language first by name; an empty
table gives an empty result; other columns are carried by ``identify``, and one
named like a result column gets underscores at its end.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.storage import stored
from .columns import free_name, make_room

BUCKETS = 1 << 16
UNKNOWN = "und"
RESULT = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"
_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK = 1 << 20
#: N-grams overlap, so three of them count as one observation.
_OVERLAP = 3


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and how often each occurs."""
    raw = b" " + (text or "").encode().translate(_TABLE) + b" "
    total = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(raw, np.uint8)
    for at in range(0, len(b) - 2, _CHUNK):
        part = b[at : at + _CHUNK + 2].astype(np.uint32)
        code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:])[part[1:-1] != 32]
        total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(16), minlength=BUCKETS)
    where = np.flatnonzero(total)
    return where, total[where].astype(np.float64)


def mixture(likely: np.ndarray, counts: np.ndarray, steps: int = 40, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``likely`` by expectation-maximisation, and the log-likelihood."""
    n, k = counts.sum(), likely.shape[1]
    share = np.full(k, 1 / k)
    for _ in range(steps if k > 1 else 0):
        new = share * (likely.T @ (counts / (likely @ share))) / n
        done = np.abs(new - share).max() < tolerance
        share = new
        if done:
            break
    return share, float(counts @ np.log(likely @ share))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, strength: float = 5000.0, penalty: float = 2.0):
        """``counts``: one row a bucket, one column a language."""
        self.languages, self.penalty = languages, penalty
        if not languages:
            return
        share = counts / np.maximum(counts.sum(0), 1)
        mean = share.mean(1, keepdims=True) + 1e-3 / BUCKETS
        self.likely = (counts + strength * mean) / (counts.sum(0) + strength * mean.sum())

    def select(self, text: str | None) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first."""
        if not text or not self.languages or not _LETTER.search(text):
            return []
        where, counts = grams(text)
        if not len(where):
            return []
        likely, size = self.likely[where], counts.sum() / _OVERLAP
        single = counts @ np.log(likely)
        chosen = [int(single.argmax())]
        share, best = np.ones(1), float(single[chosen[0]])
        bar = _OVERLAP * self.penalty * np.log(size + 2)
        left = [i for i in range(len(self.languages)) if i not in chosen]
        if left:
            # only languages with some share of the full mixture can add that much
            full, top = mixture(likely, counts)
            left = [i for i in left if full[i] > 1e-3] if top - best > bar else []
        while left:
            tried = [(*mixture(likely[:, [*chosen, i]], counts), i) for i in left]
            new, gain, i = max(tried, key=lambda x: (x[1], -x[2]))
            if gain - best <= bar:
                break
            chosen, share, best = [*chosen, i], new, gain
            left.remove(i)
        return sorted(((self.languages[i], float(s)) for i, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))

    def score(self, text: str, share: float) -> float:
        """The proportion, drawn towards even odds where the text is short."""
        size = len(text.encode()) / _OVERLAP
        return (share * size + 1) / (size + len(self.languages))


def fit(examples: DataFrame, text_col: str = "text", lang_col: str = "lang", name_col: str = "doc_id", per_language: int = 4000, max_languages: int = 400) -> Model:
    """Count n-grams by language over a bounded sample of the labelled rows."""
    rows = examples.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(name_col).cast("string").alias("name")).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: the model would not be bounded")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    rate = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, per_language / n))) for x, n in sizes.items()))
    draw = (F.xxhash64("name", F.lit(11)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for t, x in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                where, n = grams(t.as_py())
                total[place[x], where] += n.astype(np.int64)
        i, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[i, bucket], pa.int64())], names=["lang", "bucket", "n"])

    kept = stored(rows.where(draw < rate).select("text", "lang"), "examples")
    found = kept.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((BUCKETS, len(languages)))
    table = found.toArrow()  # at most BUCKETS rows a language
    counts[table["bucket"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, its text aside, with lang_pred, score and all chosen languages."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    plain = free_name(docs, "text")
    docs = make_room(docs.withColumnRenamed(text_col, plain), "lang_pred", "score", "languages")
    text_col = plain
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        m = shipped.value
        for b in batches:
            pred, score, every = [], [], []
            for t in b.column(at):
                text = t.as_py()
                found = m.select(text)
                pred.append(found[0][0] if found else UNKNOWN)
                score.append(m.score(text, found[0][1]) if found else 0.0)
                every.append([{"lang": x, "share": s} for x, s in found])
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.record_batch([*(b.column(i) for i in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(every, kind)], names=[*(b.schema.names[i] for i in keep), "lang_pred", "score", "languages"])

    return docs.mapInArrow(run, StructType([*(f for f in docs.schema.fields if f.name != text_col), *StructType.fromDDL(RESULT).fields]))


def held_out(id_col: str = "doc_id") -> "F.Column":
    """Rows that never teach: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
