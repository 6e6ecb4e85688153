"""Near-duplicate embeddings by NN-descent.

Equal vectors form one node.  A first neighbour graph comes from random
projections: for each of several tables nodes are ordered by the signs of random
projections (one more projection orders equal signs) and compared with those next
to them in that order; the order is range-partitioned, so nodes that share a code
spread over tasks.  The number of tables follows from the input's size: a pair at
the threshold is met in some table with the probability asked for.  Then the graph
is refined by neighbours-of-neighbours joins: around every node the pairs among
its neighbours, both those it lists and those that list it, are compared, and a
node keeps its best ``k``.

A node all of whose k neighbours reach the threshold is saturated: its list may
be too short, and links to other components may be missing from it.  So the members of all
components with a saturated node are compared with each other, exactly and in blocks (pieces of components
too far apart for a link, by their centres and radii, are passed over); links between two
components join them.  An audit then counts the links of a sample of nodes by
brute force; while less than ``recall`` of them is found, another round
of tables and refinement is added, and after the last round all nodes are compared with all.

Cosines are computed in double precision from the vectors as given; a link has
cosine >= threshold.

Edge cases: vectors that are null, empty, zero or hold a null or a non-finite
number link with nothing; so do rows with a null id, whose component is null;
vectors of different lengths never link; rows that repeat an id are vectors of
their own and link as such; equal vectors link; an empty table gives an empty
result; other columns, labels included, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.storage import scratch, stored

THRESHOLD = 0.95
_SPAN = 32
_AUDIT = 512
#: Blocks of an exact comparison at least, and nodes that a block holds at most on average.
_DEAL, _DEALT = 16, 16384


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.asarray(vectors.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _plain(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _lists(ids: list, sims: list) -> list[pa.Array]:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = (np.concatenate(x) if ids else np.zeros(0) for x in (ids, sims))
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, t)) for v, t in zip(flat, (pa.int64(), pa.float64()), strict=True)]


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row."""
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _first_graph(nodes: DataFrame, dim: int, k: int, tables: int, bits: int, seed: int) -> DataFrame:
    """``c, w, sim``: for every node and table the k most alike of those next to it."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, dim, bits + 1))

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(_plain(b, "v"), dim)
            for t in range(tables):
                y = x @ planes[t]
                signs = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                yield pa.record_batch([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(signs.astype(np.int64)), pa.array(y[:, bits]), _plain(b, "c"), _plain(b, "v")], names=["t", "code", "along", "c", "v"])

    kind = nodes.schema["v"].dataType.simpleString()
    coded = nodes.select("c", "v").mapInArrow(code, f"t int, code long, along double, c long, v {kind}")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(n, "t", "code", "along").sortWithinPartitions("t", "code", "along")

    def compare(batches):
        ids, x = np.zeros(0, np.int64), np.zeros((0, dim))
        done = 0  # rows at the front that serve as neighbours only

        def band(until):
            nonlocal done
            out_ids, near, sims = [], [], []
            while done < until:
                at, to = done, min(done + _SPAN, until)
                lo, hi = max(0, at - _SPAN), min(len(ids), to + _SPAN)
                s = x[at:to] @ x[lo:hi].T
                s[np.arange(to - at), np.arange(at - lo, to - lo)] = -2
                s[ids[at:to, None] == ids[None, lo:hi]] = -2
                if s.shape[1] > 1:
                    for i, p in enumerate(_best(s, k)):
                        p = p[s[i, p] > -2]
                        out_ids.append(ids[at + i])
                        near.append(ids[lo + p])
                        sims.append(s[i, p])
                done = to
            return pa.record_batch([pa.array(out_ids, pa.int64()), *_lists(near, sims)], names=["c", "near", "sims"])

        for b in batches:
            if not b.num_rows:
                continue
            ids = np.concatenate([ids, _plain(b, "c").to_numpy()])
            x = np.concatenate([x, _matrix(_plain(b, "v"), dim)])
            yield band(max(done, len(ids) - _SPAN))
            cut = max(0, done - _SPAN)
            ids, x, done = ids[cut:], x[cut:], done - cut
        yield band(len(ids))

    found = ordered.mapInArrow(compare, "c long, near array<long>, sims array<double>")
    return found.select("c", F.explode(F.arrays_zip("near", "sims")).alias("e")).select("c", F.col("e.near").alias("w"), F.col("e.sims").alias("sim"))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each node's distinct neighbours: ``c, w, sim``."""
    order = Window.partitionBy("c").orderBy(F.desc("sim"), "w")
    once = pairs.groupBy("c", "w").agg(F.max("sim").alias("sim"))
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _refine(nodes: DataFrame, graph: DataFrame, dim: int, k: int) -> DataFrame:
    """One neighbours-of-neighbours join: pairs around every node that beat a list's last entry."""
    back = Window.partitionBy("w").orderBy(F.desc("sim"), "c")
    listed_by = graph.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= k).select(F.col("w").alias("p"), F.col("c").alias("u"))
    around = graph.select(F.col("c").alias("p"), F.col("w").alias("u")).unionByName(listed_by).distinct()
    last = graph.groupBy("c").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    known = stored(nodes.select("c", "v").join(last, "c", "left").select(F.col("c").alias("u"), "v", F.when(F.col("n") >= k, F.col("least")).otherwise(-1.0).alias("least")), "known")
    joined = around.join(known, "u").groupBy("p").agg(F.collect_list(F.struct("u", "v", "least")).alias("g"))

    def compare(batches):
        for b in batches:
            g = _plain(b, "g")
            ends = np.asarray(g.offsets) - g.offsets[0].as_py() if b.num_rows else np.zeros(1, int)
            flat = g.flatten()
            if not len(flat):
                continue
            ids, least = flat.field("u").to_numpy(), flat.field("least").to_numpy()
            x = _matrix(flat.field("v"), dim)
            out: list[list] = [[], [], []]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                sims = x[s:e] @ x[s:e].T
                np.fill_diagonal(sims, -2)
                i, j = np.nonzero(sims > least[s:e, None] + 1e-15)
                out[0].append(ids[s + i])
                out[1].append(ids[s + j])
                out[2].append(sims[i, j])
            yield pa.record_batch([pa.array(np.concatenate(o)) for o in out], names=["c", "w", "sim"])

    return joined.mapInArrow(compare, "c long, w long, sim double")


def _pieces(x: np.ndarray, component: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of sorted rows start and end, their centres, and the largest angle to a centre."""
    first = np.flatnonzero(np.r_[True, (component[1:] != component[:-1]) | (piece[1:] != piece[:-1])])
    ends = np.r_[first, len(x)]
    centre = np.add.reduceat(x, first)
    length = np.sqrt((centre * centre).sum(1))
    centre = centre / np.maximum(length, 1e-300)[:, None]
    angle = np.arccos(np.clip((x * np.repeat(centre, np.diff(ends), axis=0)).sum(1), -1, 1))
    return ends, centre, np.where(length > 1e-9, np.maximum.reduceat(angle, first), math.pi)


def _exact(nodes: DataFrame, members: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """All links among ``members`` (``c, component``): rows ``c, n_linked``, and rows ``component, other`` for links between two components.

    Components are cut into pieces of about ``block`` nodes; pieces are dealt to blocks, and each pair of blocks is compared.
    Pieces are passed over only where their centres and radii leave no room for a link.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    m = stored(members.join(sizes, "component").join(nodes, "c"), "members")
    blocks = max(_DEAL, math.ceil(m.count() / _DEALT))
    piece = F.pmod(F.xxhash64("c"), F.ceil(F.col("m") / block))
    m = m.select("c", "component", "v", "n", piece.alias("piece")).withColumn("own", F.pmod(F.xxhash64("component", "piece"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = m.select(F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("left"), "c", "component", "piece", "v", "n")
    right = m.select(every.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), "c", "component", "piece", "v", "n")
    reach = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, n, component, piece = (table[x].to_numpy() for x in ("c", "n", "component", "piece"))
        order = np.lexsort((piece, component))
        is_left = table["left"].to_numpy()[order]
        mine, others = order[is_left], order[~is_left]
        total, joins = np.zeros(len(mine), np.int64), set()
        if len(mine) and len(others):
            unit = _matrix(table["v"].combine_chunks(), dim)
            x, y = unit[mine], unit[others]
            cuts, centre, radius = _pieces(x, component[mine], piece[mine])
            other_cuts, other_centre, other_radius = _pieces(y, component[others], piece[others])
            widths = np.diff(other_cuts)
            for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                apart = np.arccos(np.clip(other_centre @ centre[p], -1, 1))
                to = np.flatnonzero(np.repeat(apart <= radius[p] + other_radius + reach, widths))
                if not len(to):
                    continue
                for at in range(s, e, 256):
                    rows = slice(at, min(e, at + 256))
                    near = (x[rows] @ y[to].T >= threshold) & (ids[mine[rows]][:, None] != ids[others[to]][None, :])
                    total[rows] = near @ n[others[to]]
                    here = component[mine[s]]
                    joins.update((here, c) for c in np.unique(component[others[to[near.any(0)]]]).tolist() if c < here)
        pairs = np.array(sorted(joins), np.int64).reshape(-1, 2)
        none = lambda k: pa.nulls(k, pa.int64())
        columns = ([pa.array(ids[mine]), none(len(pairs))], [pa.array(total), none(len(pairs))], [none(len(mine)), pa.array(pairs[:, 0])], [none(len(mine)), pa.array(pairs[:, 1])])
        return pa.table([pa.chunked_array(c) for c in columns], names=["c", "n_linked", "component", "other"])

    return stored(left.unionByName(right).groupBy("i", "j").applyInArrow(compare, "c long, n_linked long, component long, other long"), "compared")


def _joined(label: DataFrame, compared: DataFrame) -> DataFrame:
    """``c, component`` with the components joined that links between them tie together."""
    joins = compared.where("component is not null").select("component", "other").distinct()
    names = connected_components(joins, "component", "other").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return stored(label.join(names, "component", "left").select("c", F.coalesce("whole", "component").alias("component")), "labels")


def _counted(compared: DataFrame) -> DataFrame:
    return compared.where("c is not null").groupBy("c").agg(F.sum("n_linked").alias("n_linked"))


def _audit(nodes: DataFrame, linked: DataFrame, dim: int, threshold: float, seed: int) -> float:
    """Share of the links of a bounded sample of nodes that were found."""
    total = nodes.count()
    draw = F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, _AUDIT / max(1, total)))
    sample = nodes.where(draw).limit(4 * _AUDIT).join(linked, "c", "left").select("c", "v", F.coalesce("n_linked", F.lit(0)).alias("got")).collect()
    if not sample:
        return 1.0
    q = _matrix(pa.array([r.v for r in sample], pa.list_(pa.float64())), dim)
    ids = np.array([r.c for r in sample])

    def count(batches):
        n = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                near = q @ _matrix(_plain(b, "v"), dim).T >= threshold
                near &= ids[:, None] != _plain(b, "c").to_numpy()[None, :]
                n += near @ _plain(b, "n").to_numpy()
        yield pa.record_batch([pa.array([int(n.sum())], pa.int64())], names=["n"])

    real = nodes.mapInArrow(count, "n long").agg(F.sum("n")).first()[0]
    return min(1.0, sum(r.got for r in sample) / real) if real else 1.0


def _links_of(nodes: DataFrame, dim: int, threshold: float, k: int, recall: float, rounds: int, block: int):
    """``c, n_linked`` and ``c, component`` (by node number) of one vector length, and the audited recall."""
    total = nodes.count()
    bits = max(1, min(40, int(math.log2(max(2, total / (2 * _SPAN))))))
    alike = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    tables = max(4, math.ceil(math.log(0.01) / math.log(max(1e-9, 1 - alike)))) if alike < 1 else 1
    graph = None
    for turn in range(rounds):
        first = _first_graph(nodes, dim, k, tables, bits, seed=97 + turn)
        graph = stored(_top(first if graph is None else graph.unionByName(first), k), "graph")
        for _ in range(2):
            graph = stored(_top(graph.unionByName(_refine(nodes, graph, dim, k)), k), "graph")
        linked = graph.where(F.col("sim") >= threshold)
        both = linked.select("c", "w").unionByName(linked.select(F.col("w").alias("c"), F.col("c").alias("w"))).distinct()
        both = stored(both, "links")
        label = connected_components(both, "c", "w").withColumnRenamed("node", "c")
        full = linked.groupBy("c").count().where(F.col("count") >= k).select("c")
        dense = stored(label.join(full, "c", "left_semi").select("component").distinct(), "dense")
        members = stored(label.join(dense, "component", "left_semi").select("c", "component"), "members")
        compared = _exact(nodes, members, dim, threshold, block)
        sizes = nodes.select(F.col("c").alias("w"), "n")
        loose = both.join(members, "c", "left_anti").join(sizes, "w").groupBy("c").agg(F.sum("n").alias("n_linked"))
        counts = stored(loose.unionByName(_counted(compared)), "counts")
        reached = _audit(nodes, counts, dim, threshold, seed=5 + turn)
        if reached >= recall:
            return counts, _joined(label.select("c", "component"), compared), reached
    # lists that stay under the recall: every node against every other
    alone = nodes.select("c").join(label.select("c", "component"), "c", "left").select("c", F.coalesce("component", "c").alias("component"))
    compared = _exact(nodes, stored(alone, "members"), dim, threshold, block)
    return _counted(compared), _joined(alone, compared), 1.0


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, k: int = 8, recall: float = 0.98, rounds: int = 3, block: int = 128) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    with scratch() as keep:
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
        spark = rows.sparkSession
        number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
        rows = keep(stored(rows.withColumn("ok", good), "vectors"))
        grouped = rows.where("ok").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"))
        nodes = stored(grouped.select(F.monotonically_increasing_id().alias("c"), "v", "n", "rep"), "nodes")
        dims = [r[0] for r in nodes.select(F.size("v")).distinct().collect()]
        counts = spark.createDataFrame([], "c long, n_linked long")
        label = spark.createDataFrame([], "c long, component long")
        for d in dims:
            own = nodes.where(F.size("v") == d)
            found, named, _ = _links_of(own, d, threshold, k, recall, rounds, block)
            counts, label = counts.unionByName(found), label.unionByName(named.select("c", "component"))
        named = nodes.select("c", "rep").join(label, "c", "left").withColumn("component", F.coalesce("component", "c"))
        named = stored(named, "named")
        smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        classes = nodes.join(named.select("c", "component"), "c").join(smallest, "component").join(counts, "c", "left")
        classes = keep(stored(classes.select("v", (F.coalesce("n_linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes"))
        linked = rows.where("ok").join(classes, "v").select("vec_id", "n_links", "component_id")
        alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding(spark, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings), p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
    walk(node, seen) as (select a, a from p union select w.node, p.b from walk w join p on p.a = w.seen), c as (select node, min(seen) as component from walk group by 1), n as (select a, count(*) as n from p group by 1)
    select vec_id, coalesce(n, 0) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept from embeddings left join n on n.a = vec_id left join c on c.node = vec_id"""
