"""Benchmark decontamination with a generalised suffix automaton.

The benchmark items, normalised to words, form one suffix automaton.  Training
words stream through it; at each word the automaton knows the longest suffix read
that is a substring of some item.  A match of at least ``window`` words marks its
words as hit; an item shorter than the window is hit where all of it occurs.

Items are split into blocks of at most ``block_words`` words, each with its own
automaton: what a task holds is bounded however many items there are.  One block
is one pass over the texts, which writes only the marks of texts with a hit; the
marks of several blocks are merged by the text's hash.  Within a document only runs of benchmark words that are long enough to
hold a window reach the automaton, which is exact: a window has no other words.

Normalisation: A-Z lower-cased; words are runs of ``0-9 a-z`` and of characters
beyond ASCII.

Edge cases: a null text or item has no words; an item without words matches
nothing; repeated item rows act as one item (their ids, or nulls, as given; a null
id is never reported); an empty benchmark hits nothing; equal rows and repeated
ids each give a row of their own; other columns are carried through untouched by
``remove_spans`` and ignored by ``contamination``.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .columns import free_name

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _WORD else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """Suffix automaton over several word sequences, with the items behind each match."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        texts = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in texts:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(ids) for _, ids in texts)])
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        #: The state of the last ``window`` words of what a state matches.
        self.anchor = [-1] * len(order)
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.anchor[s] = s if self.length[up] < window else self.anchor[up]
        self.items: dict[int, set] = {}
        self.short: dict[int, list] = {}
        for name, ids in texts:
            at = 0
            for w in ids:
                at = self.next[at][w]
                # the prefix's state, and by its anchor that of its last window
                if self.anchor[at] >= 0:
                    self.items.setdefault(self.anchor[at], set()).add(name)
            if len(ids) < window:
                self.short.setdefault(at, []).append((len(ids), name))
        #: All short items that end a match in a state: its own and those up its links.
        self.shorts: list[tuple] = [()] * len(order)
        for s in order:
            own = tuple(self.short.get(s, ()))
            self.shorts[s] = own + (self.shorts[self.link[s]] if s else ())

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans ``[start, end)`` in words, merged and ascending, and the items hit."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if len(words) < self.shortest or not self.vocab:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        wide = ends - starts >= self.shortest
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for lo, hi in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            state = matched = 0
            for at, w in enumerate(ids[lo:hi].tolist(), lo + 1):
                while state and w not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    matched += 1
                hit = matched if matched >= window else 0
                if hit:
                    found |= self.items.get(self.anchor[state], set())
                for n, name in self.shorts[state]:
                    if n <= matched:
                        found.add(name)
                        hit = max(hit, n)
                if hit:
                    start = at - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """Item lists of at most ``block_words`` words (or one item), read partition by partition."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    block, size = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        words = words_of(r.text)
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((r.id, words))
        size += len(words)
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<start:long,end:long>>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _passes(docs: DataFrame, text_col: str, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_words: int, finish, schema) -> DataFrame:
    """Stream ``docs`` through one automaton after another.

    Each pass but the last reads the texts alone and writes the marks of those with
    a hit, by two hashes of the text, since equal texts have equal marks; the last
    pass joins them, so a task never holds more than one automaton and texts are never
    written.  ``finish(batch, texts, n_words, spans, items)`` makes the result's batch.
    """
    spark, names = docs.sparkSession, docs.columns
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block, earlier = next(blocks, []), []
    key = lambda text: [F.xxhash64(text).alias("_h"), F.xxhash64(text, F.lit(1)).alias("_g")]
    for following in blocks:
        shipped = spark.sparkContext.broadcast(Automaton(block, window))

        def mark(batches, shipped=shipped):
            automaton = shipped.value
            for b in batches:
                out = []
                for h, g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    spans, found = automaton.scan(words_of(t.as_py()))
                    if spans or found:
                        out.append({"_h": h, "_g": g, "spans": _structs(spans), "items": sorted(x for x in found if x is not None)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("_h", pa.int64()), ("_g", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]))

        marks = docs.where(F.col(text_col).isNotNull()).select(*key(text_col), F.col(text_col)).mapInArrow(mark, f"_h long, _g long, spans {_SPANS_SQL}, items array<string>")
        earlier.append(stored(marks.dropDuplicates(["_h", "_g"]), "marks"))
        block = following
    shipped = spark.sparkContext.broadcast(Automaton(block, window))
    at, source = names.index(text_col), docs
    if earlier:
        every = earlier[0]
        for m in earlier[1:]:
            every = every.unionByName(m)
        # at most one entry for each block
        every = every.groupBy("_h", "_g").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        rows = docs.select(F.struct(*names).alias("_row"), *key(text_col))
        source = rows.join(every, ["_h", "_g"], "left").select(*(F.col("_row")[c].alias(c) for c in names), F.struct("spans", "items").alias(free_name(docs, "marks")))

    marked = bool(earlier)

    def run(batches):
        automaton = shipped.value
        for b in batches:
            before = b.column(len(names)).to_pylist() if marked else repeat(None)
            texts, n_words, spans, items = [], [], [], []
            for t, old in zip(b.column(at), before, strict=False):
                texts.append(t.as_py())
                words = words_of(texts[-1])
                n_words.append(len(words))
                hit, found = automaton.scan(words)
                if old and old["spans"] is not None:
                    hit = _merged(hit + [(x["start"], x["end"]) for x in old["spans"]])
                    found |= set(old["items"])
                spans.append(hit)
                items.append(sorted(x for x in found if x is not None))
            yield finish(pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names), texts, n_words, spans, items)

    return source.mapInArrow(run, schema)


def _structs(spans) -> list[dict]:
    return [{"start": s, "end": e} for s, e in spans]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 500_000) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items``: hit word spans and item ids (strings, sorted) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def finish(b, texts, n_words, spans, items):
        n_hit = [sum(e - s for s, e in x) for x in spans]
        columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([_structs(x) for x in spans], _SPANS), pa.array(items, pa.list_(pa.string()))]
        return pa.record_batch(columns, names=["doc_id", "n_words", "n_hit", "spans", "items"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, spans {_SPANS_SQL}, items array<string>"
    return _passes(rows, "text", benchmark, item_id, item_text, window, block_words, finish, schema)


def is_contaminated(n_hit="n_hit", n_words="n_words", share: int = 20):
    """Some word is hit, and at least one word in ``share``."""
    return (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 500_000) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit words of the others.

    A document with a hit, but too few hit words to be contaminated, keeps the
    rest of its text: each hit span goes, from its first to its last word.
    """
    at = docs.columns.index(text_col)

    def finish(b, texts, n_words, spans, items):
        n = [sum(e - s for s, e in x) for x in spans]
        keep = [not h or share * h < w for h, w in zip(n, n_words, strict=True)]
        left = [cut_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
        columns = list(b.columns)
        columns[at] = pa.array(left, b.schema.field(at).type)
        return pa.record_batch(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return _passes(docs, text_col, benchmark, item_id, item_text, window, block_words, finish, docs.schema)


def cut_spans(text: str, spans) -> str:
    """``text`` without the words of the ascending, disjoint word spans."""
    raw = text.encode()
    plain = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : edges[2 * s]])
        last = int(edges[2 * e - 1])
    return b"".join([*out, raw[last:]]).decode()


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""with d as (select doc_id, coalesce({SQL_WORDS.format("text")}, []) as w from documents), i as (select item_id, {SQL_WORDS.format("text")} as w from benchmark where text is not null), ik as (select item_id, w, least(13, len(w)) as k from i where len(w) > 0),
    ig as (select distinct item_id, k, array_to_string(w[j:j+k-1], ' ') as g from (select item_id, w, k, unnest(range(1, len(w)-k+2)) as j from ik)), ks as (select distinct k from ig),
    dg as (select doc_id, k, j, array_to_string(w[j:j+k-1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w)-k+2)) as j from d, ks where len(w) >= k)), m as (select doc_id, j, dg.k, item_id from dg join ig on dg.g = ig.g and dg.k = ig.k),
    h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(j, j+k)) as p from m) group by 1), t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from m group by 1)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (doc_id) left join t using (doc_id)"""
