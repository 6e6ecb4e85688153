"""Repeated paragraphs by MinHash banding, and repeated passages that no line break sets off.

A paragraph is a line of at least ``min_words`` words (lower-cased runs of letters
and digits).  Equal paragraphs meet by a 64-bit hash.  Distinct ones are compared
by MinHash over shingles of five words, in bands that are tuned so that a pair at
the similarity limit collides with the probability asked for.  In every bucket each
paragraph is verified against the bucket's first by the exact Jaccard similarity of
the shingle sets; buckets whose members this leaves in several classes are compared
further, whatever is outside a bucket's largest class with all its members, in
blocks, so no link that a bucket holds is missed.  Verified links are clustered
into components.

A passage may also stand inside a longer line or run over several short ones.  So the
word stream of every text is cut into windows of ``WINDOW`` words that begin at
anchors: an anchor is the shingle with the least hash of ``REACH`` shingles in a row
(a MinHash of one row, slid along the text).  Two texts that share ``WINDOW + REACH -
1`` words in a row (50) share an anchor and the window behind it, wherever the
passage stands; windows are verified as equal, and count where several documents hold them.  (Of two windows of one anchor that
differ, nearly all are under the similarity limit: one changed word takes five of
their shingles.)

Of each class the first member, by document id, row and position, stays; the others
are removals.  ``remove_repeats`` cuts removed lines whole, and removed windows but for
words that a window which stays shares with them.

Words and shingles are taken as 64-bit hashes.

Edge cases: a null text has neither paragraphs nor passages; texts of fewer than ``REACH
+ 4`` words have no windows; a line that repeats within one document counts; rows that share a
document id are told apart by their texts; rows equal in id and text act as one
document; null ids come last; an empty table gives an empty result; other columns
are ignored by ``paragraph_classes`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.storage import scratch, stored
from .columns import free_name
from .decontaminate import _TABLE, SQL_WORDS

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 20
#: Words of a window, and shingles in a row of which the least is an anchor.
WINDOW, REACH = 25, 26
BLOCK = 512
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: An anchor's hash is a sum over the low 30 bits of its words, so that SQL can follow it.
_ANCHOR = (668265263, 374761393, 1013904223, 971215073, 433494437)
_PRIME, _LOW = (1 << 31) - 1, (1 << 30) - 1
_STEP = 1 << 15


def tune_bands(similarity: float = SIMILARITY, recall: float = 0.999, most: int = 40) -> tuple[int, int]:
    """Bands and rows a band: the longest rows for which the limit pair still collides with ``recall``."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches the recall: allow more hashes")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    """Hashes of words, kept up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "little")
        return h


class _Text:
    """A text's words as hashes, where they stand, and its lines of at least ``min_words`` words."""

    def __init__(self, text: str, hashes: _WordHashes, min_words: int):
        raw = text.encode()
        plain = raw.translate(_TABLE)
        self.x = np.fromiter(map(hashes.__getitem__, plain.split()), np.uint64)
        edges = np.flatnonzero(np.diff(np.frombuffer(b" " + plain + b" ", np.uint8) != 32))
        self.starts, self.ends = edges[::2], edges[1::2]
        data = np.frombuffer(raw, np.uint8)
        breaks = np.flatnonzero(data == 10)
        line_starts, line_ends = np.r_[0, breaks + 1], np.r_[breaks, len(raw)]
        first = np.searchsorted(self.starts, np.r_[line_starts, len(raw)])
        self.lines = np.flatnonzero(np.diff(first) >= min_words)
        self.first, self.past = first[self.lines], first[self.lines + 1]
        self.line_starts, self.line_ends = line_starts[self.lines], line_ends[self.lines]
        # code points before each byte, where the two differ
        self.points = None if len(text) == len(raw) else np.r_[0, np.cumsum((data & 0xC0) != 0x80)]

    def place(self, at: np.ndarray) -> np.ndarray:
        return at if self.points is None else self.points[at]


def _shingles(x: np.ndarray) -> np.ndarray:
    """The hash of the shingle that begins at each word; the last ones run beyond the words."""
    x = np.concatenate([x, np.zeros(SHINGLE - 1, np.uint64)])
    return _mix(sum((x[i : len(x) - SHINGLE + 1 + i] * _POWERS[i] for i in range(SHINGLE)), np.zeros(len(x) - SHINGLE + 1, np.uint64)))


def _hashed(x: np.ndarray) -> np.ndarray:
    """One hash for each row of word hashes."""
    h = np.full(len(x), x.shape[1], np.uint64)
    for i in range(x.shape[1]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, i])
    return h.astype(np.int64)


def _anchors(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where windows begin in the words of several texts, which end at ``ends``."""
    n = len(x) - SHINGLE + 1
    if n < REACH:
        return np.zeros(0, np.int64)
    low = (x & np.uint64(_LOW)).astype(np.int64)
    value = sum(low[i : n + i] * _ANCHOR[i] for i in range(SHINGLE)) % _PRIME
    # the least value, of equal ones the last: the place stands inverted in the low bits
    best = (value << 32) + ((1 << 32) - 1 - np.arange(n))
    width = 1
    while 2 * width <= REACH:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < REACH:
        best = np.minimum(best[: len(best) - (REACH - width)], best[REACH - width :])
    place = (1 << 32) - 1 - (best & ((1 << 32) - 1))
    end = np.repeat(ends, np.diff(np.r_[0, ends]))  # of the text that a word stands in
    place = np.unique(place[np.arange(len(best)) + REACH + SHINGLE - 1 <= end[: len(best)]])
    return place[place + WINDOW <= end[place]]


_UNITS = "doc_id long, row long, para int, start long, end long, n_words int, h long, keys array<long>"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, text``: ``row`` tells rows of one id apart by their texts."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, bands: int = 10, rows: int = 3) -> DataFrame:
    """Every paragraph (``para`` is its line) with its band keys, and every window (``para`` is its first word), without."""
    if min_words < SHINGLE:
        raise ValueError("a paragraph has a shingle at least")
    rng = np.random.default_rng(20)
    salt = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    odd = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(shingles, first, past):
        pairs = np.stack([first, past - SHINGLE + 1], 1).ravel()
        keys = np.zeros((bands, len(first)), np.uint64)
        if len(first):
            for k in range(bands * rows):
                low = np.minimum.reduceat((shingles ^ salt[k]) * odd[k], pairs)[::2]
                keys[k // rows] = _mix(keys[k // rows] * np.uint64(31) + low + np.uint64(k))
        return keys.T.astype(np.int64)

    def run(batches):
        hashes = _WordHashes()
        for b in batches:
            ids, marks, held, size = b.column(0).to_pylist(), b.column(1).to_pylist(), [], 0
            for doc, row, text in zip(ids, marks, b.column(2), strict=True):
                t = _Text(text.as_py() or "", hashes, min_words)
                held.append((doc, row, t))
                size += len(t.x)
                if size > _STEP:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    def batch(held):
        ends = np.cumsum([len(t.x) for *_, t in held])
        x = np.concatenate([t.x for *_, t in held])
        before = ends - [len(t.x) for *_, t in held]
        at = _anchors(x, ends)
        of = np.searchsorted(ends, at, side="right")
        shingles = _shingles(x)
        many = [len(t.lines) for *_, t in held]
        first, past = (np.concatenate([getattr(t, name) + o for o, (*_, t) in zip(before, held, strict=True)]) for name in ("first", "past"))
        keys = signatures(shingles, first.astype(np.int64), past.astype(np.int64))
        raw = x.tobytes()
        hs = [xxhash.xxh64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(first.tolist(), past.tolist(), strict=True)]
        window = at[:, None] + np.arange(WINDOW)
        cuts = np.searchsorted(of, np.arange(len(held) + 1))
        spans = [(t.place(t.starts[at[s:e] - o]), t.place(t.ends[at[s:e] - o + WINDOW - 1])) for o, s, e, (*_, t) in zip(before, cuts[:-1], cuts[1:], held, strict=True)]
        whose = np.concatenate([np.repeat(np.arange(len(held)), many), of])
        ids = pa.array([doc for doc, *_ in held], pa.int64()).take(pa.array(whose))
        marks = pa.array([row for _, row, _ in held], pa.int64()).take(pa.array(whose))
        starts = np.concatenate([*(t.place(t.line_starts) for *_, t in held), *(s for s, _ in spans)])
        stops = np.concatenate([*(t.place(t.line_ends) for *_, t in held), *(e for _, e in spans)])
        para = np.concatenate([*(t.lines for *_, t in held), at - before[of]])
        n_words = np.concatenate([past - first, np.full(len(at), WINDOW)])
        h = np.concatenate([np.array(hs, np.uint64).astype(np.int64), _hashed(x[window])])
        offsets = np.r_[np.arange(len(hs)) * bands, np.full(len(at) + 1, len(hs) * bands)].astype(np.int32)
        none = np.r_[np.zeros(len(hs), bool), np.ones(len(at) + 1, bool)]
        none[-1] = False  # an offset, not an entry
        lists = pa.ListArray.from_arrays(pa.array(offsets, mask=none), pa.array(keys.ravel()))
        columns = [ids, marks, *(pa.array(np.asarray(c), t) for c, t in ((para, pa.int32()), (starts, pa.int64()), (stops, pa.int64()), (n_words, pa.int32()), (h, pa.int64())))]
        return pa.record_batch([*columns, lists], names=["doc_id", "row", "para", "start", "end", "n_words", "h", "keys"])

    return _rows(docs, id_col, text_col).mapInArrow(run, _UNITS)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``h, shingles`` of the wanted paragraphs (``row, h``), read again from a row that holds them."""
    per_row = wanted.groupBy(F.col("row").alias("of")).agg(F.collect_set("h").alias("hs"))
    source = _rows(docs, id_col, text_col)
    source = source.join(per_row, F.col("row") == F.col("of")).select("text", "hs")

    def run(batches):
        hashes = _WordHashes()
        for b in batches:
            for text, hs in zip(b.column(0), b.column(1), strict=True):
                asked, out, sets = set(hs.as_py()), [], []
                t = _Text(text.as_py() or "", hashes, min_words)
                shingles, raw = _shingles(t.x).view(np.int64), t.x.tobytes()
                for s, e in zip(t.first.tolist(), t.past.tolist(), strict=True):
                    h = xxhash.xxh64_intdigest(raw[8 * s : 8 * e])
                    h -= (h >> 63) << 64
                    if h in asked:
                        asked.discard(h)
                        out.append(h)
                        sets.append(np.unique(shingles[s : e - SHINGLE + 1]))
                if out:
                    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                    yield pa.record_batch([pa.array(out, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["h", "shingles"])

    return source.mapInArrow(run, "h long, shingles array<long>")


def _verified(distinct: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Links ``a, b`` between distinct paragraphs (h, row, keys) that join them as all links within buckets do."""
    keyed = distinct.select("h", F.explode("keys").alias("key"))
    full = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.count("*").alias("n")).where("n > 1")
    hits = stored(keyed.join(full, "key").select("key", "h", "lo", "n"), "buckets")
    star = stored(hits.where("h <> lo").select("h", "lo").distinct(), "pairs")
    nodes = star.select("h").unionByName(star.select(F.col("lo").alias("h"))).distinct()
    sets = stored(_shingle_sets(docs, nodes.join(distinct.select("h", "row"), "h"), id_col, text_col, min_words).dropDuplicates(["h"]), "sets")
    pairs = star.join(sets.withColumnRenamed("shingles", "s"), "h").join(sets.select(F.col("h").alias("lo"), F.col("shingles").alias("t")), "lo")
    both = F.size(F.array_intersect("s", "t"))
    near = both >= similarity * (F.size("s") + F.size("t") - both)
    first = stored(pairs.where(near).select(F.col("h").alias("a"), F.col("lo").alias("b")), "near")

    # buckets of three and more whose members are not all of one class yet
    label = stored(connected_components(first, "a", "b").withColumnRenamed("node", "h").withColumnRenamed("component", "label"), "labels")
    large = hits.where("n > 2").join(label, "h", "left").select("key", "h", F.coalesce("label", "h").alias("label"))
    per = large.groupBy("key", "label").agg(F.count("*").alias("k"), F.sum(F.xxhash64("h").cast("decimal(20,0)")).alias("sum"))
    per = per.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("classes"), F.sum("k").alias("m"), F.max("k").alias("most"), F.sum("sum").alias("sum"))
    # buckets of the same members say the same
    open_ = stored(per.where("classes > 1").dropDuplicates(["m", "sum"]).select("key", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("np")), "open")
    if open_.isEmpty():
        return first
    m = stored(large.join(open_, "key").join(sets, "h"), "members")
    blk, part = F.pmod(F.xxhash64("h"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("h", F.lit(1)), F.col("np")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = m.where("label <> main").select("key", every("nb").alias("blk"), part.alias("part"), F.lit(True).alias("ask"), "label", "h", "shingles")
    others = m.select("key", blk.alias("blk"), every("np").alias("part"), F.lit(False).alias("ask"), "label", "h", "shingles")
    return first.unionByName(stored(_links(asking.unionByName(others), similarity), "near"))


def _links(dealt: DataFrame, similarity: float) -> DataFrame:
    """Spanning links ``a, b`` of each group (key, blk, part): rows that ask are compared with all others, unless of one label."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key", "blk", "part").sortWithinPartitions("key", "blk", "part")

    def links(rows):
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        asks, label, sets = {}, {}, {}
        for ask, of, h, s in rows:
            sets[h], label[h], asks[h] = s, of, ask or asks.get(h, False)
        hs = list(sets)
        # an inverted index of the group: intersections of one set with all others are counts
        sizes = np.array([len(s) for s in sets.values()])
        values, terms = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
        order = np.argsort(terms, kind="stable")
        where = np.repeat(np.arange(len(hs)), sizes)[order]
        starts = np.r_[0, np.cumsum(np.bincount(terms, minlength=len(values)))]
        bounds = np.r_[0, np.cumsum(sizes)]
        for i, x in enumerate(hs):
            if not asks[x]:
                continue
            held = terms[bounds[i] : bounds[i + 1]]
            both = np.bincount(np.concatenate([where[s:e] for s, e in zip(starts[held], starts[held + 1], strict=True)]), minlength=len(hs))
            for j in np.flatnonzero(both >= similarity * (sizes[i] + sizes - both)).tolist():
                if find(label[x]) != find(label[hs[j]]):
                    parent[find(label[x])] = find(label[hs[j]])
                    yield x, hs[j]

    def run(batches):
        key, rows = None, []
        for b in batches:
            out: list = []
            columns = [b.column(i).to_pylist() for i in range(6)]
            shingles = b.column(6)
            for at, (k, blk, part, ask, of, h) in enumerate(zip(*columns, strict=True)):
                if (k, blk, part) != key:
                    if rows:
                        out += links(rows)
                    key, rows = (k, blk, part), []
                rows.append((ask, of, h, shingles[at].values.to_numpy()))
            if out:
                yield edges(out)
        if rows and (out := [*links(rows)]):
            yield edges(out)

    def edges(out):
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def paragraph_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = 0.999, min_words: int = MIN_WORDS) -> DataFrame:
    """Every paragraph and window that repeats: ``doc_id, row, kind, para, start, end, n_words, component_id, keeper_doc, keeper_para, n_members, removed``.

    ``kind`` is ``line`` or ``passage``; ``para`` is the line's number or the window's first word; ``start`` and ``end``
    are code points of the text; ``component_id`` names the class; ``row`` tells rows of one id apart.
    """
    with scratch() as keep:
        bands, rows = tune_bands(similarity, recall)
        every = keep(stored(units(docs, id_col, text_col, min_words, bands, rows), "units"))
        lines, windows = every.where("keys is not null"), every.where("keys is null").drop("keys")
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "para")
        distinct = stored(lines.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("keys").alias("keys")), "distinct")
        links = _verified(distinct.select("h", "first.row", "keys"), docs, similarity, id_col, text_col, min_words)
        linked = connected_components(links, "a", "b").withColumnRenamed("node", "h")
        named = stored(distinct.select("h", "n", "first").join(linked, "h", "left").select("h", "n", "first", F.coalesce("component", "h").alias("component")), "named")
        classes = named.groupBy("component").agg(F.sum("n").alias("n_members"), F.min("first").alias("keeper")).where("n_members > 1")
        classes = keep(stored(named.select("h", "component").join(classes, "component"), "classes"))
        equal = windows.groupBy("h").agg(F.count("*").alias("n_members"), F.min(place).alias("keeper"), F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi")
        equal = keep(stored(equal.select("h", F.col("h").alias("component"), "n_members", "keeper"), "passages"))
        out = lines.drop("keys").join(classes, "h").withColumn("kind", F.lit("line")).unionByName(windows.join(equal, "h").withColumn("kind", F.lit("passage")))
        stays = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("row") == F.col("keeper.row")) & (F.col("para") == F.col("keeper.para"))
        return out.select("doc_id", "row", "kind", "para", "start", "end", "n_words", F.col("component").alias("component_id"), F.col("keeper.doc_id").alias("keeper_doc"), F.col("keeper.para").alias("keeper_para"), "n_members", (~stays).alias("removed"))


def cut_removed(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """``text`` without removed lines, and without removed windows where no window that stays covers them.

    A line that goes takes its break with it.
    """
    gone = np.zeros(len(text) + 1, bool)
    for mark in (True, False):
        for start, end, kind, removed in spans:
            if kind == "passage" and removed == mark:
                gone[start:end] = mark
    for start, end, kind, removed in spans:
        if kind == "line" and (removed or gone[start:end].all()):
            gone[start:end] = True
            at = end if end < len(text) else start - 1
            if at >= 0:
                gone[at] = True
    edges = np.flatnonzero(np.diff(np.r_[True, gone[: len(text)], True]))
    return "".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without what ``paragraph_classes`` marks as removed; other texts stay as they are."""
    found = paragraph_classes(docs, id_col, text_col, **options)
    per_row = found.groupBy(F.col("row").alias("_of")).agg(F.collect_set(F.struct("start", "end", "kind", "removed")).alias("spans")).where(F.exists("spans", lambda x: x["removed"]))
    row, spans = free_name(docs, "row"), free_name(docs, "spans")
    marked = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), text_col))
    marked = marked.join(per_row.withColumnRenamed("spans", spans), F.col(row) == F.col("_of"), "left").select(*docs.columns, spans)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for b in batches:
            texts = [cut_removed(t.as_py(), [tuple(x.values()) for x in s.as_py()]) if s.is_valid else t.as_py() for t, s in zip(b.column(at), b.column(len(names)), strict=True)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.record_batch(columns, names=names)

    return marked.mapInArrow(run, docs.schema)


def op6_paragraphs(spark, sf_dir: str) -> DataFrame:
    """Classes are named by their keeper, so that they can be told without the hash."""
    return paragraph_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("component_id", "row")


_SQL_ANCHOR = " + ".join(f"lead(m, {i}) over x * {c}" for i, c in enumerate(_ANCHOR))
_SQL_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP6_SQL = f"""with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
    s as (select doc_id, cast(k - 1 as int) as para, line, sum(length(line) + 1) over (partition by doc_id order by k) - length(line) - 1 as start, {SQL_WORDS.format("line")} as w from l), q as (select *, row_number() over (order by doc_id, para) as id, array_to_string(w, ' ') as norm from s where len(w) >= {MIN_WORDS}),
    u as (select norm, any_value(w) as w, min(id) as rep from q group by norm), g as (select distinct rep, array_to_string(w[j:j+4], ' ') as sh from (select rep, w, unnest(range(1, len(w) - 3)) as j from u)), n as (select rep, count(*) as n from g group by 1),
    b as (select x.rep as a, y.rep as b, count(*) as inter from g x join g y on x.sh = y.sh and x.rep <> y.rep group by 1, 2), e as (select b.a, b.b from b join n x on x.rep = b.a join n y on y.rep = b.b where inter >= {SIMILARITY} * (x.n + y.n - inter)),
    walk(node, seen) as (select a, a from e union select w.node, e.b from walk w join e on e.a = w.seen), c as (select node, min(seen) as c from walk group by 1), z as (select q.*, coalesce(c.c, u.rep) as comp from q join u using (norm) left join c on c.node = u.rep),
    t as (select comp, count(*) as n_members from z group by 1 having count(*) > 1),
    d as (select doc_id, text, {SQL_WORDS.format("text")} as w from documents), k as (select doc_id, unnest(regexp_extract_all(text, '{_SQL_PIECE}')) as piece, unnest(w) as word, generate_subscripts(w, 1) as j, len(w) as n from d),
    o as (select doc_id, j, n, word, sum(length(piece)) over (partition by doc_id order by j) as stop, (md5_number_upper(word) & {_LOW})::bigint as m from k),
    v as (select doc_id, j, n, ({_SQL_ANCHOR}) % {_PRIME} as v from o window x as (partition by doc_id order by j)),
    a as (select distinct doc_id, 4294967295 - (low & 4294967295) as j from (select doc_id, n, j, min((v << 32) + 4294967295 - j) over (partition by doc_id order by j rows between current row and {REACH - 1} following) as low from v where v is not null) where j + {REACH + SHINGLE - 2} <= n),
    p as (select doc_id, a.j, x.stop - length(x.word) as start, y.stop, array_to_string(w[a.j:a.j+{WINDOW - 1}], ' ') as norm from a join o x using (doc_id, j) join o y using (doc_id) join d using (doc_id) where y.j = a.j + {WINDOW - 1}),
    r as (select norm, count(*) as n_members, min(struct_pack(doc_id := doc_id, j := j)) as keeper from p group by 1 having count(distinct doc_id) > 1)
    select z.doc_id, 'line' as kind, z.para, cast(z.start as bigint) as start, cast(z.start + length(z.line) as bigint) as "end", cast(len(z.w) as int) as n_words, k.doc_id as keeper_doc, k.para as keeper_para, n_members, z.id <> k.id as removed from z join t using (comp) join q k on k.id = z.comp
    union all select doc_id, 'passage', cast(j - 1 as int), cast(start as bigint), cast(stop as bigint), {WINDOW}, keeper.doc_id, cast(keeper.j - 1 as int), n_members, doc_id <> keeper.doc_id or j <> keeper.j from p join r using (norm)"""
