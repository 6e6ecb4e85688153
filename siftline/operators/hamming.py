"""Pairs of 64-bit hashes within a radius, exactly, by pairs of blocks.

Rows are dealt to blocks by a hash of theirs, so that blocks are alike in size whatever
the values are, and each pair of blocks is one unit of work.  Within it either all
pairs are compared by words, or a band index proposes candidates: the cheaper by the counts,
which are known before.  Hits leave in batches of bounded size and are never gathered.
"""

from __future__ import annotations

from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..plans.storage import stored

BANDS, BAND_BITS = 4, 16
#: Rows of a block at most, in expectation; and, below, how small tables are cut so that several tasks share them.
BLOCK, SMALL, SPREAD = 1 << 17, 1 << 10, 8
#: Pairs compared at once, and hits in a batch.
CHUNK, BATCH = 1 << 18, 1 << 15
#: Costs in pairs compared by words: of a look-up in a band index, and of a candidate it gives.
LOOKUP, CANDIDATE = 8, 16


def probes(within: int) -> np.ndarray:
    """All masks of at most ``within`` bits of a band."""
    return np.array([sum(1 << b for b in bits) for n in range(within + 1) for bits in combinations(range(BAND_BITS), n)], np.int64)


def shares(radius: int) -> list[int]:
    """How many bits each band may differ in: were all bands beyond theirs, the whole would be beyond the radius."""
    total = radius - BANDS + 1
    return [total // BANDS + (i < total % BANDS) for i in range(BANDS)] if total >= 0 else [0] * (radius + 1)


def _all(a: np.ndarray, b: np.ndarray, radius: int):
    step = max(1, CHUNK // max(1, len(b)))
    for s in range(0, len(a), step):
        d = np.bitwise_count(a[s : s + step, None] ^ b[None, :])
        i, j = np.divmod(np.flatnonzero(d <= radius), max(1, len(b)))
        yield i + s, j


def _band(h: np.ndarray, i: int) -> np.ndarray:
    return ((h >> np.uint64(BAND_BITS * i)) & np.uint64((1 << BAND_BITS) - 1)).astype(np.int64)


def _indexed(a: np.ndarray, b: np.ndarray, radius: int):
    """Each pair once: by the first band that is close enough."""
    limits = shares(radius)
    for i, within in enumerate(limits):
        ka, kb = _band(a, i), _band(b, i)
        order = np.argsort(kb, kind="stable")
        sorted_b = b[order]
        starts = np.searchsorted(kb[order], np.arange((1 << BAND_BITS) + 1))
        for mask in probes(within):
            start = starts[ka ^ mask]
            n = starts[(ka ^ mask) + 1] - start
            ends = np.cumsum(n)
            cuts = np.searchsorted(ends, np.arange(CHUNK, ends[-1] + CHUNK, CHUNK), "right")
            for lo, hi in zip([0, *cuts], [*cuts, len(a)], strict=True):
                m = n[lo:hi]
                if not (size := int(m.sum())):
                    continue
                at = np.repeat(start[lo:hi] - np.cumsum(m) + m, m) + np.arange(size)
                own = np.repeat(np.arange(lo, hi), m)
                diff = a[own] ^ sorted_b[at]
                hit = np.flatnonzero(np.bitwise_count(diff) <= radius)
                for k in range(i):  # those that an earlier band has found
                    hit = hit[np.bitwise_count(_band(diff[hit], k)) > limits[k]]
                yield own[hit], order[at[hit]]


def candidates(a: np.ndarray, b: np.ndarray, radius: int) -> int:
    """How many pairs the band index proposes."""
    total, keys = 0, np.arange(1 << BAND_BITS)
    for i, within in enumerate(shares(radius)):
        na, nb = (np.bincount(_band(h, i), minlength=1 << BAND_BITS) for h in (a, b))
        total += sum(int(na @ nb[keys ^ mask]) for mask in probes(within))
    return total


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int):
    """Places ``(i, j)`` of all pairs of unsigned hashes that differ in at most ``radius`` bits, in batches, each pair once."""
    every = len(a) * len(b)
    if not every:
        return
    looked = LOOKUP * len(a) * sum(len(probes(n)) for n in shares(radius))
    by_index = looked < every and looked + CANDIDATE * candidates(a, b, radius) < every
    for i, j in (_indexed if by_index else _all)(a, b, radius):
        for s in range(0, len(i), BATCH):
            yield i[s : s + BATCH], j[s : s + BATCH]


def _dealt(rows: DataFrame, h: str, key: str) -> tuple[DataFrame, int]:
    """Stored rows once for each pair of blocks that theirs is in, the pairs apart and in one piece each; and the number of blocks."""
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(SPREAD, -(-n // SMALL)))
    own = F.pmod(F.xxhash64(h, key), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("_block", own).withColumn("_other", other)
    dealt = dealt.withColumn("_pair", F.least("_block", "_other") * blocks + F.greatest("_block", "_other")).drop("_other")
    return dealt.repartition(blocks * (blocks + 1) // 2, "_pair").sortWithinPartitions("_pair"), blocks


def _units(batches, blocks: int):
    """For each pair of blocks its rows, those of the first block first, and the places of the two; they are the same for a block with itself."""
    parts = (p for b in batches for p in _runs(b))
    for pair, found in groupby(parts, key=lambda p: p[0]):
        t = pa.Table.from_batches([b for _, b in found])
        block = t.column("_block").to_numpy()
        first, second = np.flatnonzero(block == pair // blocks), np.flatnonzero(block == pair % blocks)
        yield t.drop_columns(["_block", "_pair"]).combine_chunks(), first, second


def _runs(batch):
    pair = batch.column("_pair").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield int(pair[lo]), batch.slice(lo, hi - lo)


def _hits(t, first: np.ndarray, second: np.ndarray, h: str, key: str, radius: int):
    """Places of the close pairs of a unit in batches, that with the smaller key first; keys that are equal or null make no pair."""
    hashes = t.column(h).to_numpy().view(np.uint64)
    keys = t.column(key).combine_chunks()
    once = first is second or np.array_equal(first, second)
    for i, j in close_pairs(hashes[first], hashes[second], radius):
        i, j = first[i], second[j]
        if once:
            i, j = i[i < j], j[i < j]
        x, y = keys.take(pa.array(i)), keys.take(pa.array(j))
        less, more = (f(x, y).fill_null(False).to_numpy(zero_copy_only=False) for f in (pc.less, pc.greater))
        a, b = np.where(more, j, i)[less | more], np.where(more, i, j)[less | more]
        if len(a):
            yield a, b, np.bitwise_count(hashes[a] ^ hashes[b]).astype(np.int32)


class Arrays:
    """Arrays of numbers of a unit's rows, and corr, mae and psnr of pairs of them as ``similarity.pair_metrics`` defines them.

    Sums run over the elements in order, as Spark's do.  Where an element is null or lengths differ, corr is 0 and the rest is null.
    The values stay as they came, one after another: neither copies nor room for the longest array in every row.
    """

    def __init__(self, column):
        column = column.combine_chunks()
        self.size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten()
        self.first = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        if values.null_count:
            holes = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False))
            full = np.flatnonzero(self.size > 0)
            self.size[full[np.searchsorted(self.first[full], holes, "right") - 1]] = -1
            values = values.fill_null(0)
        self.values = values.to_numpy(zero_copy_only=False)
        self.sum, self.square = np.zeros(len(self.size)), np.zeros(len(self.size))
        for rows, n in self._alike(self.size):
            for k in range(n):
                x = self._at(self.first[rows] + k)
                self.sum[rows] += x
                self.square[rows] += x * x

    @staticmethod
    def _alike(sizes: np.ndarray):
        """Places of equal sizes over 0, in batches, and the size."""
        order = np.argsort(sizes, kind="stable")
        ranked = sizes[order]
        cuts = [0, *(np.flatnonzero(np.diff(ranked)) + 1).tolist(), len(ranked)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo and ranked[lo] > 0:
                for s in range(lo, hi, BATCH):
                    yield order[s : min(s + BATCH, hi)], int(ranked[lo])

    def _at(self, places: np.ndarray) -> np.ndarray:
        return self.values[places].astype(np.float64)

    def metrics(self, a: np.ndarray, b: np.ndarray) -> list:
        n = self.size[a].astype(np.float64)
        odd = (self.size[a] <= 0) | (self.size[a] != self.size[b])
        both, away, square = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
        with np.errstate(all="ignore"):
            for at, size in self._alike(np.where(odd, 0, self.size[a])):
                one, two = self.first[a[at]], self.first[b[at]]
                xy, ad, dd = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
                for k in range(size):
                    x, y = self._at(one + k), self._at(two + k)
                    xy += x * y
                    d = x - y
                    ad += np.abs(d)
                    dd += d * d
                both[at], away[at], square[at] = xy, ad, dd
            sa, sb = self.sum[a], self.sum[b]
            cov = both - sa * sb / n
            under = np.sqrt(np.maximum((self.square[a] - sa * sa / n) * (self.square[b] - sb * sb / n), 0.0))
            corr = np.where(odd | (under == 0), 0.0, cov / under)
            mse = square / n
            psnr = np.where(mse <= 0, 999.0, 10 * np.log10(1 / mse))
            return [pa.array(corr), pa.array(away / n, mask=odd), pa.array(psnr, mask=odd | (1 / mse <= 0))]


def pairs_of_rows(rows: DataFrame, h: str, radius: int, key: str, columns: list[str] = (), arrays: str | None = None) -> DataFrame:
    """Pairs ``key_a < key_b`` of rows whose hashes differ in at most ``radius`` bits, with the columns of both and ``distance``.

    With a column of ``arrays`` also ``corr, mae, psnr`` of the two.
    """
    names = [key, *columns]
    more = [F.col(arrays).alias("_arrays")] if arrays else []
    kept = stored(rows.where(F.col(h).isNotNull()).select(F.col(h).alias("_hash"), *names, *more), "hashes")
    dealt, blocks = _dealt(kept, "_hash", key)
    types = {f.name: f.dataType for f in kept.schema.fields}
    measured = ["corr", "mae", "psnr"] if arrays else []
    schema = StructType([*(StructField(f"{c}_{x}", types[c]) for c in names for x in "ab"), StructField("distance", IntegerType()), *(StructField(c, DoubleType()) for c in measured)])

    def run(batches):
        for t, first, second in _units(batches, blocks):
            held = Arrays(t.column("_arrays")) if arrays else None
            for a, b, distance in _hits(t, first, second, "_hash", key, radius):
                sides = [t.column(c).combine_chunks().take(pa.array(x)) for c in names for x in (a, b)]
                yield pa.record_batch([*sides, pa.array(distance), *(held.metrics(a, b) if arrays else [])], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _alike(values, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where the values of a pair are equal, 0 where not, 2 where one is null."""
    return pc.equal(values.take(pa.array(a)), values.take(pa.array(b))).cast(pa.int8()).fill_null(2).to_numpy(zero_copy_only=False)


def counts_of_pairs(rows: DataFrame, h: str, radius: int, key: str, column: str | None = None) -> DataFrame:
    """``same, distance, n`` of the pairs that ``pairs_of_rows`` lists, counted where they are found; ``same`` is null without a column or where one is null."""
    value = F.col(column) if column else F.lit(None).cast("int")
    kept = stored(rows.where(F.col(h).isNotNull()).select(F.col(h).alias("_hash"), key, value.alias("_v")), "hashes")
    dealt, blocks = _dealt(kept, "_hash", key)

    def run(batches):
        for t, first, second in _units(batches, blocks):
            counts = np.zeros((3, radius + 1), np.int64)
            values = t.column("_v").combine_chunks()
            for a, b, distance in _hits(t, first, second, "_hash", key, radius):
                np.add.at(counts, (_alike(values, a, b), distance), 1)
            kind, distance = np.nonzero(counts)
            yield pa.record_batch([pa.array([(False, True, None)[k] for k in kind], pa.bool_()), pa.array(distance.astype(np.int32)), pa.array(counts[kind, distance])], names=["same", "distance", "n"])

    found = dealt.mapInArrow(run, "same boolean, distance int, n long")
    return found.groupBy("same", "distance").agg(F.sum("n").alias("n"))


def _passed(metrics: list, gate: dict) -> np.ndarray:
    """Where corr, mae and psnr pass a gate; as Spark orders them, nan is above all numbers and null passes none."""
    corr, mae, psnr = (m.fill_null(np.nan).to_numpy(zero_copy_only=False) for m in metrics)
    known = metrics[1].is_valid().to_numpy(zero_copy_only=False) & metrics[2].is_valid().to_numpy(zero_copy_only=False)
    return known & ~(corr < gate["corr"]) & (mae <= gate["mae"]) & ~(psnr < gate["color"])


def gates_of_pairs(rows: DataFrame, h: str, radius: int, key: str, arrays: str, gates: dict, column: str) -> DataFrame:
    """``gate, same, n``: how many of the pairs that ``pairs_of_rows`` lists pass each gate, counted where they are found; ``same`` as in ``counts_of_pairs``."""
    kept = stored(rows.where(F.col(h).isNotNull()).select(F.col(h).alias("_hash"), key, F.col(column).alias("_v"), F.col(arrays).alias("_arrays")), "hashes")
    dealt, blocks = _dealt(kept, "_hash", key)

    def run(batches):
        for t, first, second in _units(batches, blocks):
            counts = np.zeros((len(gates), 3), np.int64)
            values, held = t.column("_v").combine_chunks(), Arrays(t.column("_arrays"))
            for a, b, _ in _hits(t, first, second, "_hash", key, radius):
                metrics, alike = held.metrics(a, b), _alike(values, a, b)
                for i, gate in enumerate(gates.values()):
                    counts[i] += np.bincount(alike[_passed(metrics, gate)], minlength=3)
            gate, kind = np.nonzero(counts)
            yield pa.record_batch([pa.array([list(gates)[g] for g in gate], pa.string()), pa.array([(False, True, None)[k] for k in kind], pa.bool_()), pa.array(counts[gate, kind])], names=["gate", "same", "n"])

    found = dealt.mapInArrow(run, "gate string, same boolean, n long")
    return found.groupBy("gate", "same").agg(F.sum("n").alias("n"))
