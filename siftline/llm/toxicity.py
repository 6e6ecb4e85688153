"""Toxicity by nearest labelled examples.

Labelled rows are examples.  A text's vector has three parts: its length, the TF-IDF vector of all its words, scaled
to the same weight, and extra weight on terms (words, and the first bytes of longer
words, which carry over to forms not seen) that tell classes apart when tested against
the label.  A document's score comes from its k
nearest examples by exact cosine in that space: votes are weighted by similarity,
a prior stands for what no example says, and a logistic curve calibrates the vote;
it is fitted on the votes that the other examples cast on each example.  The nearest examples are returned as
evidence.

Search uses a block-max inverted index of all words of the examples: blocks of examples whose
bound is below the k-th best similarity are not scored, so the result is exact.

The index is fitted on at most ``max_examples`` labelled rows in expectation (a
documented bound; the hash of the id decides, at equal rates within a class), with all their
words; at most ``max_terms`` tested terms get extra weight.  Words that no example has count in a document's length
only.  Every document is scored whole, one pass, no shuffle.

Edge cases: a null or empty text, or one without a word of any example, gets the prior's
calibrated score; null labels are no examples; without examples of both classes
the score is the share of label 1 (0 without labels); repeated rows and ids are
scored row by row; an empty table gives an empty result; equal similarities are
ordered by the example's place in the index; other columns are carried; one named like a
result column gets underscores at its end.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.storage import stored
from .columns import free_name, make_room
from .decontaminate import words_of

PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
RESULT = "score double, predicted int, evidence array<struct<example:string,similarity:double,label:int>>"


def terms_of(text: str | None) -> Counter:
    words = words_of(text)
    out = Counter(words)
    for n in PREFIXES:
        out.update(b"^" + w[:n] for w in words if len(w) > n)
    return out


class BlockMaxIndex:
    """Exact top-k by inner product over sparse unit vectors.

    Vectors are dealt to blocks of alike ones.  Frequent terms stand in a table with each block's maxima; the others have
    posting lists, which a query adds up whole.  What these give, and the maxima of the frequent terms, bound every block;
    blocks are scored from the best bound down, and those whose bound is below the k-th best score never are.
    """

    BLOCK, FREQUENT, SHARE = 32, 512, 0.1

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        sizes = np.array([len(v) for v in vectors], np.int64)
        terms = np.fromiter((t for v in vectors for t in v), np.int32)
        weights = np.fromiter((w for v in vectors for w in v.values()), np.float64)
        self._fill(sizes, terms, weights, n_terms)

    @classmethod
    def of(cls, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> "BlockMaxIndex":
        """From the vectors' entries one after another."""
        index = cls.__new__(cls)
        index._fill(sizes, terms, weights, n_terms)
        return index

    def _fill(self, sizes, terms, weights, n_terms) -> None:
        self.n = len(sizes)
        held = np.bincount(terms, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[: self.FREQUENT]
        often = often[held[often] >= max(1, self.SHARE * self.n)]
        #: Column of a frequent term in the table, else -1.
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        whose, column = np.repeat(np.arange(self.n), sizes), self.column[terms]
        table = np.zeros((self.n, len(often)))
        table[whose[column >= 0], column[column >= 0]] = weights[column >= 0]
        order = self._alike(table)
        self.blocks = -(-self.n // self.BLOCK)
        #: The vector at each place of the blocks; -1 fills the last one.
        self.vector = np.r_[order, np.full(self.blocks * self.BLOCK - self.n, -1)].astype(np.int64)
        whole = np.zeros((self.blocks * self.BLOCK, len(often)))
        whole[: self.n] = table[order]
        #: Of each block the weights by frequent term, so that a query reads its own terms only.
        self.table = np.ascontiguousarray(whole.reshape(self.blocks, self.BLOCK, len(often)).transpose(0, 2, 1))
        self.most = self.table.max(2) if self.n else np.zeros((0, len(often)))
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        rare = np.flatnonzero(column < 0)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        self.where, self.weight = place[whose[rare]].astype(np.int32), weights[rare]
        self.starts = np.r_[0, np.cumsum(np.bincount(terms[rare], minlength=n_terms))]

    @staticmethod
    def _alike(table: np.ndarray) -> np.ndarray:
        """An order in which vectors with the same leading direction, and of them those of like weight there, are neighbours."""
        if not table.size:
            return np.arange(len(table))
        _, _, axes = np.linalg.svd(table[:: max(1, len(table) // 1000)], full_matrices=False)
        along = np.abs(table @ axes[:6].T)
        return np.lexsort((along.max(1), along.argmax(1)))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k largest positive products as (product, vector), best first, ties by vector."""
        if not len(terms) or not self.n:
            return []
        column = self.column[terms]
        often, heavy = column[column >= 0], weights[column >= 0]
        q = np.zeros(self.table.shape[1])
        q[often] = heavy
        rare, w = terms[column < 0], weights[column < 0]
        start = self.starts[rare]
        n = self.starts[rare + 1] - start
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        parts = np.repeat(w, n)
        parts *= self.weight.take(at)
        # without postings the counts are whole numbers
        base = np.bincount(self.where.take(at), parts, self.blocks * self.BLOCK).astype(np.float64, copy=False).reshape(self.blocks, self.BLOCK)
        bound = base.max(1) + self.most @ q + 1e-9
        order = np.argsort(-bound)
        scores, found, least, done, width = np.zeros(0), np.zeros(0, np.int64), 0.0, 0, 6
        while done < self.blocks and bound[order[done]] >= least:
            live = order[done : done + width]
            live = live[bound[live] >= least]
            new = np.round((base[live] + heavy @ self.table[live[:, None], often]).ravel(), 12)
            near = np.flatnonzero((new > 0) & (new >= least))
            scores = np.concatenate([scores, new[near]])
            found = np.concatenate([found, self.vector.reshape(self.blocks, self.BLOCK)[live].ravel()[near]])
            if len(scores) > k:
                least = np.partition(scores, -k)[-k]
                scores, found = scores[scores >= least], found[scores >= least]
            done += width
            width += width // 2
        best = np.lexsort((found, -scores))[:k]
        return list(zip(scores[best].tolist(), found[best].tolist(), strict=True))


class Model:
    def __init__(self, vocab: dict[bytes, int], idf: np.ndarray, known: dict[bytes, int], known_idf: np.ndarray, unseen_idf: float, prior: float, k: int, prior_weight: float, rest: float):
        self.vocab, self.idf, self.k, self.prior, self.prior_weight = vocab, np.asarray(idf, np.float64), k, prior, prior_weight
        self.words = {t for t in vocab if t[:1] != b"^"}
        self.heads = [(n, {t[1:]: i for t, i in vocab.items() if t[:1] == b"^" and len(t) == n + 1}) for n in PREFIXES]
        #: All words of the examples: their dimensions follow those of the tested terms.
        self.known, self.known_idf, self.unseen_idf = known, np.asarray(known_idf, np.float64), unseen_idf
        #: Weight of the length and of all words together, so that a few tested terms in a long text weigh little.
        self.rest = rest
        self.marked = np.zeros(len(known), bool)
        self.marks = {i: m for w, i in known.items() if (m := self.tested(w))}
        self.marked[list(self.marks)] = True
        self.n_terms = len(vocab) + len(known) + 1  # the last one is the length
        self.labels, self.names, self.index = [], [], BlockMaxIndex([], self.n_terms)
        self.slope, self.offset = 1.0, 0.0
        self.calibrated = False

    def teach(self, index: BlockMaxIndex, labels: list, names: list) -> None:
        self.index, self.labels, self.names = index, labels, names

    def tested(self, word: bytes) -> list[int]:
        """The tested terms that a word holds."""
        own = [self.vocab[word]] if word in self.words else []
        return own + [head[p] for n, head in self.heads if len(word) > n and (p := word[:n]) in head]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text's unit vector."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        # counted first: a look-up among all words of the examples costs more than one among the text's
        counts = Counter(words)
        ids = np.fromiter(map(self.known.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        unseen = {w: c for (w, c), i in zip(counts.items(), ids.tolist(), strict=True) if i < 0} if ids.min() < 0 else {}
        order = np.argsort(ids)[len(unseen) :]
        ids, n = ids[order], n[order]
        whole = self.known_idf[ids] * (1 + np.log(n))
        out: Counter = Counter()
        for i, c in zip(ids[self.marked[ids]].tolist(), n[self.marked[ids]].tolist(), strict=True):
            for t in self.marks[i]:
                out[t] += c
        square = float(whole @ whole)
        for w, c in unseen.items():
            square += (self.unseen_idf * (1 + math.log(c))) ** 2
            for t in self.tested(w):
                out[t] += c
        tested = np.array(sorted(out), np.int64)
        marks = self.idf[tested] * (1 + np.log([out[t] for t in tested.tolist()]))
        length = self.rest * (1 + math.log(len(words)))
        norm = math.sqrt(float(marks @ marks) + 2 * length * length)
        terms = np.concatenate([tested, ids + len(self.vocab), [self.n_terms - 1]])
        return terms, np.concatenate([marks, whole * (length / math.sqrt(square)), [length]]) / norm

    def vote(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.top(*self.vector(text), self.k)
        return self.tally(near), near

    def tally(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1 among the neighbours and the prior, weighted by similarity."""
        total = self.prior_weight + sum(s for s, _ in near)
        return (sum(s * self.labels[i] for s, i in near) + self.prior_weight * self.prior) / total

    def score(self, vote: float) -> float:
        if not self.calibrated:
            return float(min(1.0, max(0.0, vote)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * vote + self.offset))))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit by Newton steps on targets drawn in from 0 and 1 by the class sizes."""
        pos, neg = labels.sum(), len(labels) - labels.sum()
        if not pos or not neg:
            return
        target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.stack([votes, np.ones_like(votes)], 1)
        w, penalty = np.zeros(2), np.array([1e-3, 1e-6])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - target) + penalty * w)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if w[0] > 0:
            self.slope, self.offset, self.calibrated = float(w[0]), float(w[1]), True


def unit(v: dict[int, float]) -> dict[int, float]:
    norm = math.sqrt(sum(w * w for w in v.values()))
    return {t: w / norm for t, w in v.items()} if norm else {}


def fit(examples: DataFrame, text_col: str = "text", label_col: str = "toxic", name_col: str = "doc_id", max_examples: int = 8000, max_terms: int = 4096, min_docs: int = 4, min_chi2: float = 20.0, k: int = 15, prior_weight: float = 0.1, rest: float = 1.5) -> Model:
    """Fit on a sample of labelled rows: terms, index, and the calibration of votes with each example left out."""
    rows = examples.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(sizes.values())
    rate = min(1.0, max_examples / total) if total else 1.0
    draw = (F.xxhash64("name", F.lit(1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    kept = stored(rows.where(draw < rate), "examples")
    counts = {r.y: r["count"] for r in kept.groupBy("y").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    n = n1 + n0
    prior = n1 / n if n else 0.0

    def explode(batches):
        for b in batches:
            ys, terms = [], []
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = terms_of(t.as_py())
                terms += found
                ys += [y] * len(found)
                if len(terms) > 100_000:
                    yield pairs(terms, ys)
                    ys, terms = [], []
            yield pairs(terms, ys)

    def pairs(terms, ys):
        return pa.record_batch([pa.array(terms, pa.binary()), pa.array(ys, pa.int32())], names=["term", "y"])

    seen = kept.select("text", "y").mapInArrow(explode, "term binary, y int")
    df1 = F.sum("y")
    every = stored(seen.groupBy("term").agg(F.count("*").alias("n"), df1.alias("n1")), "terms")
    stats = every.where(F.col("n") >= min_docs)
    a, m = F.col("n1").cast("double"), F.col("n").cast("double")
    gap = a * (n - m - n1 + a) - (m - a) * (n1 - a)
    chi2 = n * gap * gap / F.greatest(m * (n - m) * float(n1) * float(n0), F.lit(1.0))
    chosen = stats.select("term", "n", chi2.alias("chi2")).where(F.col("chi2") >= min_chi2).orderBy(F.desc("chi2"), "term").limit(max_terms).collect()
    vocab = {bytes(r.term): i for i, r in enumerate(chosen)}
    idf = np.array([math.log((1 + n) / (1 + r.n)) + 1 for r in chosen])
    words = every.where("substring(term, 1, 1) <> X'5E'").select("term", "n").orderBy("term").toArrow()
    # frequent words first, so that most look-ups fall on a small part of the table; their numbers follow the terms' order
    named, held = words["term"].to_pylist(), words["n"].to_numpy()
    known = {named[i]: i for i in np.argsort(-held, kind="stable").tolist()}
    known_idf = (np.log((1 + n) / (1 + held)) + 1).tolist()
    model = Model(vocab, idf, known, known_idf, math.log(1 + n) + 1, prior, k, prior_weight, rest)

    def embed(batches):
        for b in batches:
            vectors = [model.vector(t.as_py()) for t in b.column(1)]
            columns = [b.column(0), b.column(2), pa.array([t for t, _ in vectors], pa.list_(pa.int32())), pa.array([w for _, w in vectors], pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=["name", "y", "terms", "weights"])

    # at most max_examples rows, with their distinct words
    points = kept.select("name", "text", "y").mapInArrow(embed, "name string, y int, terms array<int>, weights array<double>").toArrow().combine_chunks()
    names, labels = points["name"].to_pylist(), points["y"].to_pylist()
    column = lambda c: points[c].combine_chunks() if n else pa.array([], pa.list_(pa.float64()))
    ends = np.asarray(column("terms").offsets)
    terms, weights = column("terms").flatten().to_numpy().astype(np.int32), column("weights").flatten().to_numpy()
    spans = [slice(s - ends[0], e - ends[0]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    order = sorted(range(len(names)), key=lambda i: (names[i] or "", labels[i], terms[spans[i]].tobytes()))
    spans = [spans[i] for i in order]
    chain = lambda values: np.concatenate([values[x] for x in spans] or [values])
    labels = [labels[i] for i in order]
    model.teach(BlockMaxIndex.of(np.array([x.stop - x.start for x in spans], np.int64), chain(terms), chain(weights), model.n_terms), labels, [names[i] for i in order])
    votes = np.zeros(len(spans))
    for i, x in enumerate(spans):
        near = [p for p in model.index.top(terms[x], weights[x], k + 1) if p[1] != i][:k]
        votes[i] = model.tally(near)
    model.calibrate(votes, np.array(labels))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep: str = "all", evidence: int = 3) -> DataFrame:
    """``docs`` with score, predicted and evidence; ``keep="clean"``: instead, the rows of ``docs`` not predicted toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    only_clean = keep == "clean"
    if not only_clean:
        plain = free_name(docs, "text")
        docs = make_room(docs.withColumnRenamed(text_col, plain), "score", "predicted", "evidence")
        text_col = plain
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("example", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        m = shipped.value
        for b in batches:
            scores, proof = [], []
            for t in b.column(at):
                vote, near = m.vote(t.as_py())
                scores.append(m.score(vote))
                proof.append([{"example": m.names[i], "similarity": s, "label": m.labels[i]} for s, i in near[:evidence]])
            s = np.array(scores, np.float64)
            if only_clean:
                yield b.filter(pa.array(s < threshold))
            else:
                yield pa.record_batch([*(c for i, c in enumerate(b.columns) if i != at), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(proof, kind)], names=[*(x for i, x in enumerate(b.schema.names) if i != at), "score", "predicted", "evidence"])

    if only_clean:
        return docs.mapInArrow(run, docs.schema)
    return docs.mapInArrow(run, StructType([*(f for f in docs.schema.fields if f.name != text_col), *StructType.fromDDL(RESULT).fields]))


def held_out(id_col: str = "doc_id") -> "F.Column":
    """Rows that never teach: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Fit on ``documents`` that ``labels`` (doc_id, toxic) covers and that aren't held out."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), "toxic").where(~held_out("_id"))
    bound = options.get("max_examples", 8000)
    total = known.count()
    if total > bound:  # thin the ids before they meet the texts
        known = known.where((F.xxhash64("_id", F.lit(3)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) < bound / total)
    return fit(docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")), **options)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
