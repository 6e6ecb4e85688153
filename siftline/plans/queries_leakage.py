"""Near duplicates by two hashes, their scores, and what leaks through them between splits.

The items are documents with two 64-bit hashes, an aspect and a few boxes, all made
of the document's number: neighbours share the base of both hashes, and some bits
differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..operators import graph, leakage, manifest, similarity
from .base import SQL_DOCS, docs, query, relation_sql
from .queries_curation import _DECIDED, _gone
from .storage import stored

_H = "('0x' || substr(md5('{0}' || cast({1} as varchar)), 1, 16))::ubigint"
_MASK = "case when doc_id % 5 < 2 then 0::ubigint else " + " & ".join(_H.format("{0}" + x, "doc_id") for x in "xyz") + " end"
_IMG = f"""img as (select doc_id, printf('d%09d', doc_id) as stem, split, xor({_H.format("p", "doc_id // 5")}, {_MASK.format("p")}) as p, xor({_H.format("q", "(doc_id + 2) // 7")}, {_MASK.format("q")}) as d, 1 + (doc_id % 3) * 0.05 as aspect,
    (doc_id % 4) * 0.05 as off, cast((doc_id // 2) % 2 as int) as cls, cast(1 + doc_id % 2 as int) as n from docs)"""
_NEAR = f"""{SQL_DOCS}, {_IMG}, pair as (select a.doc_id as id_a, b.doc_id as id_b, a.stem as stem_a, b.stem as stem_b, a.split as split_a, b.split as split_b, cast(bit_count(xor(a.p, b.p)) as int) as p_distance, cast(bit_count(xor(a.d, b.d)) as int) as d_distance, abs(a.aspect - b.aspect) / greatest(a.aspect, b.aspect) as gap,
    a.off as off_a, b.off as off_b, a.n as n_a, b.n as n_b, a.cls as cls_a, b.cls as cls_b from img a join img b on a.doc_id < b.doc_id), near as (select *, {relation_sql("split_a", "split_b")} as relation from pair where (p_distance <= 10 or d_distance <= 10) and p_distance <= 20 and d_distance <= 20 and gap <= 0.08)"""
#: Made-up image metrics and the state of the boxes of a pair; boxes of one class are shifted against each other.
_SCORED = f"""{_NEAR}, q1 as (select *, 1 - p_distance / 20000.0 as corr, d_distance / 2000.0 as mae, 50.0 - p_distance as psnr, 1 - d_distance / 10000.0 as color, cls_a = cls_b as alike, least(off_a + 0.5, off_b + 0.5) - greatest(off_a, off_b) as wide from near),
    q2 as (select *, case when alike then (wide * 0.5) / ((off_a + 0.5 - off_a) * 0.5 + (off_b + 0.5 - off_b) * 0.5 - wide * 0.5) else 0 end as iou from q1),
    q3 as (select *, case when alike and n_a = n_b and off_a = off_b then 'EXACT' when alike and n_a = n_b and iou >= 0.7 then 'STRONG' when alike and n_a = n_b and iou >= 0.5 then 'MODERATE' else 'CONFLICT' end as state, case when corr >= 0.9995 and mae <= 0.005 and psnr >= 40 and color >= 0.999 then 'EXTREME' when corr >= 0.999 and mae <= 0.010 and color >= 0.995 then 'ULTRA' else 'OTHER' end as tier from q2),
    scored as (select *, case when tier = 'EXTREME' and state in ('EXACT', 'STRONG') then 'VERY_HIGH' when tier = 'EXTREME' then 'HIGH' when tier = 'ULTRA' and state in ('EXACT', 'STRONG') then 'HIGH' when tier = 'ULTRA' and state = 'MODERATE' then 'MEDIUM' else 'REVIEW' end as priority from q3)"""


def _hash(salt: str, number):
    return s.hash_bits(F.substring(F.md5(F.concat(F.lit(salt), number.cast("string"))), 1, 16))


def hashed_items(spark, sf_dir):
    k = F.col("doc_id")
    mask = lambda name: F.when(k % 5 < 2, F.lit(0).cast("bigint")).otherwise(_hash(name + "x", k).bitwiseAND(_hash(name + "y", k)).bitwiseAND(_hash(name + "z", k)))
    base = docs(spark, sf_dir, "doc_id", "split")
    return base.select(
        "doc_id", F.format_string("d%09d", k).alias("stem"), "split", _hash("p", F.floor(k / 5)).bitwiseXOR(mask("p")).alias("p"), _hash("q", F.floor((k + 2) / 7)).bitwiseXOR(mask("q")).alias("d"), (1 + (k % 3) * 0.05).alias("aspect"),
    )


def _near(spark, sf_dir):
    return similarity.near_duplicate_candidates(hashed_items(spark, sf_dir), "doc_id", columns=["stem", "split"])


@query("near_duplicate_candidates", f"with {_NEAR} select stem_a, stem_b, relation, p_distance, d_distance, round(gap, 8) as aspect_difference from near")
def near_duplicate_candidates(spark, sf_dir):
    n = _near(spark, sf_dir)
    return n.select("stem_a", "stem_b", s.relation("split_a", "split_b").alias("relation"), F.col("p_distance").cast("int").alias("p_distance"), F.col("d_distance").cast("int").alias("d_distance"), F.round("aspect_difference", 8).alias("aspect_difference"))


@query("exact_hash_pairs", f"with {_NEAR} select stem_a, stem_b from pair where p_distance = 0 and d_distance = 0")
def exact_hash_pairs(spark, sf_dir):
    return similarity.exact_hash_pairs(hashed_items(spark, sf_dir), ["p", "d"], "stem").select("stem_a", "stem_b")


def _boxes(k):
    """One or two boxes of a document: a class of its own, and the other class further down."""
    off, cls = (k % 4) * 0.05, (F.floor(k / 2) % 2).cast("int")
    box = lambda y: F.struct(off.alias("x1"), F.lit(y).alias("y1"), (off + 0.5).alias("x2"), F.lit(y + 0.5).alias("y2"))
    one, two = F.struct(cls.alias("cls"), box(0.0).alias("box")), F.struct((1 - cls).alias("cls"), box(0.5).alias("box"))
    return F.when(k % 2 == 1, F.array(one, two)).otherwise(F.array(one))


def _scored(spark, sf_dir):
    n = _near(spark, sf_dir)
    made = {"corr": 1 - F.col("p_distance") / 20000, "mae": F.col("d_distance") / 2000, "psnr": 50.0 - F.col("p_distance"), "color": 1 - F.col("d_distance") / 10000}
    pairs = n.withColumns(made | {f"boxes_{x}": _boxes(F.col(f"doc_id_{x}")) for x in "ab"})
    return leakage.score_pairs(pairs).withColumn("relation", s.relation("split_a", "split_b"))


@query("pair_scores", f"with {_SCORED} select stem_a, stem_b, relation, tier, state, priority, round(iou, 8) as mean_iou from scored")
def pair_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("stem_a", "stem_b", "relation", "tier", "state", "priority", F.round("match30.mean_iou", 8).alias("mean_iou"))


_EDGES = f"""{_SCORED}, edge as (select * from scored where split_a <> split_b), und as (select stem_a as a, stem_b as b from edge union select stem_b, stem_a from edge)"""
_COMP = f"""with recursive {_EDGES}, walk(node, seen) as (select a, a from und union select w.node, b.b from walk w join und b on b.a = w.seen), comp as (select node, least(node, min(seen)) as component from walk group by node),
    mem as (select c.component, c.node, i.split, (select count(*) from und where a = c.node) as degree, (select count(*) from und x join img t on t.stem = x.b where x.a = c.node and t.split = 'test') as test_neighbors from comp c join img i on i.stem = c.node)"""
_COUNTED = ", ".join(f"count(*) filter (where {c} = '{v}') as {n}" for c, names in leakage.EDGE_COUNTS.items() for v, n in names.items())
_STATS = f"""{_COMP}, ed as (select c.component, {_COUNTED} from edge join comp c on c.node = edge.stem_a group by 1),
    g as (select component, count(*) as nodes, cast(sum(degree) // 2 as bigint) as edges, min(degree) as min_degree, max(degree) as max_degree, round(avg(degree), 8) as mean_degree, count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'val') as n_val, count(*) filter (where split = 'test') as n_test,
    count(*) filter (where test_neighbors > 0 and split <> 'test') as direct_non_test_nodes_to_test, string_agg(distinct split, '_' order by case split when 'train' then 0 when 'val' then 1 else 2 end) as spans from mem group by 1),
    st as (select g.* exclude (spans), round(edges / (nodes * (nodes - 1) / 2.0), 8) as density, array_to_string(list_filter(['train', 'val', 'test'], lambda x: list_contains([case when n_train > 0 then 'train' end, case when n_val > 0 then 'val' end, case when n_test > 0 then 'test' end], x)), '_') as type, ed.* exclude (component) from g join ed using (component))"""


def _edges(spark, sf_dir):
    """Scored pairs across splits."""
    e = _scored(spark, sf_dir).where("split_a <> split_b")
    return e.select(F.col("stem_a").alias("a"), F.col("stem_b").alias("b"), "doc_id_a", "doc_id_b", "split_a", "split_b", "relation", "tier", "state", "priority")


def _members(spark, sf_dir):
    edges = stored(_edges(spark, sf_dir), "edges")
    return edges, leakage.members(edges, hashed_items(spark, sf_dir).select(F.col("stem").alias("node"), "split"))


def _stats(spark, sf_dir):
    edges, rows = _members(spark, sf_dir)
    rows = stored(rows, "members")
    st = leakage.component_stats(rows).join(leakage.edge_stats(edges, rows), "component")
    names = [n for counts in leakage.EDGE_COUNTS.values() for n in counts.values()]
    return st.select("component", "nodes", "edges", "min_degree", "max_degree", F.round("mean_degree", 8).alias("mean_degree"), "n_train", "n_val", "n_test", "direct_non_test_nodes_to_test", F.round("density", 8).alias("density"), "type", *names)


@query("leakage_components", f"{_STATS} select * from st")
def leakage_components(spark, sf_dir):
    return _stats(spark, sf_dir)


@query("largest_component", f"{_STATS} select component, nodes, edges, type from st order by nodes desc, edges desc, component limit 1")
def largest_component(spark, sf_dir):
    return leakage.largest(_stats(spark, sf_dir)).select("component", "nodes", "edges", "type")


@query("component_members", f"{_COMP} select * from mem")
def component_members(spark, sf_dir):
    return _members(spark, sf_dir)[1].select("component", "node", "split", "degree", "test_neighbors")


@query("component_sizes", f"{_COMP}, g as (select component, count(*) as nodes from comp group by 1) select nodes, count(*) as n from g group by nodes")
def component_sizes(spark, sf_dir):
    c = graph.connected_components(_edges(spark, sf_dir), "a", "b").groupBy("component").agg(F.count("*").alias("nodes"))
    return c.groupBy("nodes").agg(F.count("*").alias("n"))


_DIRECT = f"""with {_EDGES}, s as (select stem_a as a, stem_b as b, split_a as sa, split_b as sb from edge), t1 as (select sb as split, b as stem from s where sa='test' and sb<>'test' union select sa, a from s where sb='test' and sa<>'test'),
    alive as (select * from s where a not in (select stem from t1) and b not in (select stem from t1)), t2 as (select b as stem, sb as split from alive where sa='val' and sb not in ('val','test') union select a, sa from alive where sb='val' and sa not in ('val','test'))"""


def _direct(spark, sf_dir):
    names = hashed_items(spark, sf_dir).select(F.col("stem").alias("key"), "split")
    e = stored(_edges(spark, sf_dir), "edges")
    gone = stored(leakage.direct_exclusion(e, "test"), "test_leaks")
    layer = manifest.without(names, gone, ("key",))
    left = leakage.alive(e, layer)
    second = leakage.direct_exclusion(left, "val").where("split <> 'test'")
    return names, e, gone, layer, second


@query("direct_exclusion", f"{_DIRECT} select 'test_protected' as layer, split, stem from t1 union all select 'cross_split', split, stem from t2")
def direct_exclusion(spark, sf_dir):
    _, _, gone, _, second = _direct(spark, sf_dir)
    return manifest.stack({"test_protected": gone, "cross_split": second}).select("layer", "split", F.col("key").alias("stem"))


@query("surviving_edges", f"{_DIRECT}, f as (select list_sort([sa, sb]) as k from s where a not in (select stem from t1) and b not in (select stem from t1)) select count(*) filter (where k = ['test','train']) as test_train, count(*) filter (where k = ['test','val']) as test_val, count(*) filter (where k = ['train','val']) as val_train from f")
def surviving_edges(spark, sf_dir):
    """Edges between splits that the first removal leaves: none to the test split."""
    _, e, _, layer, _ = _direct(spark, sf_dir)
    return leakage.surviving_counts(e, layer, [("test", "train"), ("test", "val"), ("val", "train")])


@query("layered_manifests", f"{_DIRECT}, c1 as (select stem, split from img where stem not in (select stem from t1)), c2 as (select * from c1 where stem not in (select stem from t2)) select 'original' as layer, split, count(*) as n from docs group by 2 union all select 'clean_test_protected', split, count(*) from c1 group by 2 union all select 'frozen', split, count(*) from c2 group by 2")
def layered_manifests(spark, sf_dir):
    names, _, _, layer, second = _direct(spark, sf_dir)
    layers = {"original": names, "clean_test_protected": layer, "frozen": manifest.without(layer, stored(second, "val_leaks"), ("key",))}
    return manifest.stack({k: v.select("split", "key") for k, v in layers.items()}).groupBy("layer", "split").agg(F.count("*").alias("n"))


_LAYERS = f"""{_DECIDED}, {_EDGES.removeprefix(SQL_DOCS + ", ")}, gone as (select doc_id, split, max(role) as role from (select e.role, e.doc_id, x.split from e join docs x on x.doc_id = e.doc_id where role <> 'keep') group by 1, 2), clean as (select doc_id, split from docs where doc_id not in (select doc_id from gone)),
    s as (select edge.id_a as a, edge.id_b as b, x.split as sa, y.split as sb from edge join clean x on x.doc_id = edge.id_a join clean y on y.doc_id = edge.id_b), t1 as (select sb as split, b as doc_id from s where sa='test' and sb<>'test' union select sa, a from s where sb='test' and sa<>'test'),
    alive as (select * from s where a not in (select doc_id from t1) and b not in (select doc_id from t1)), t2 as (select b as doc_id from alive where sa='val' and sb not in ('val','test') union select a from alive where sb='val' and sa not in ('val','test')),
    c1 as (select * from clean where doc_id not in (select doc_id from t1)), c2 as (select * from c1 where doc_id not in (select doc_id from t2)),
    u as (select 'original' as layer, split from docs union all select 'exclude_exact', split from gone where role='exclude' union all select 'quarantine_exact', split from gone where role='quarantine' union all select 'clean_exact', split from clean union all select 'clean_test_protected', split from c1 union all select 'frozen', split from c2)"""


@query("curated_layers", f"{_LAYERS} select layer, split, count(*) as n from u group by 1, 2")
def curated_layers(spark, sf_dir):
    """The whole curation: exact duplicates by annotation, then leakage against test and val."""
    from .curation import layered_manifest

    d = docs(spark, sf_dir, "doc_id", "split")
    e = stored(_edges(spark, sf_dir).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "split_a", "split_b"), "edges")
    return layered_manifest(d, _gone(spark, sf_dir), e, "doc_id").groupBy("layer", "split").agg(F.count("*").alias("n"))
