"""Duplicates, manifests, similarity, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..operators import dedup, manifest, similarity
from .base import SQL_ANN, SQL_DOCS, SQL_DUP, annotations, docs, query, read, relation_sql


@query("exact_dup_leakage", f"""with {SQL_DOCS}, g as (select sha256(text) as sha, count(*) as n, bool_or(split='train') as tr, bool_or(split='val') as va, bool_or(split='test') as te from docs group by 1 having count(*) > 1)
    select cast(tr and te as int) as train_test, cast(tr and va as int) as train_val, cast(va and te as int) as val_test, count(*) as n_groups, cast(sum(n) as bigint) as n_members from g group by 1,2,3""")  # fmt: skip
def exact_dup_leakage(spark, sf_dir):
    d = docs(spark, sf_dir, "text", "split").select(F.sha2("text", 256).alias("sha"), "split")
    per = d.groupBy("sha", "split").agg(F.count("*").alias("n")).groupBy("sha").agg(F.sum("n").alias("n"), F.collect_set("split").alias("splits")).where("n > 1")
    flags = dedup.leakage_flags(per)
    return flags.groupBy(*(F.col(c).cast("int").alias(c) for c in ("train_test", "train_val", "val_test"))).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_members"))


_GROUPS = f"""{SQL_DOCS}, g as (select sha256(text) as digest, count(*) as n, min(doc_id) as first_id, string_agg(distinct split, '+' order by split) as signature from docs group by 1 having count(*) > 1)"""


@query("exact_dup_groups", f"with {_GROUPS} select row_number() over (order by n desc, first_id) as group_id, n, first_id, signature from g")
def exact_dup_groups(spark, sf_dir):
    groups = dedup.hash_groups(docs(spark, sf_dir, "doc_id", "text", "split"), "doc_id", "text")
    return dedup.numbered(groups).select("group_id", "n", F.col("first").alias("first_id"), "signature")


@query("group_size_distribution", f"with {_GROUPS} select n, count(*) as n_groups from g group by n")
def group_size_distribution(spark, sf_dir):
    d = docs(spark, sf_dir, "text").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).where("n > 1")
    return d.groupBy("n").agg(F.count("*").alias("n_groups"))


@query("size_prefilter_dups", """with c as (select *, count(*) over (partition by n_chars) as k from documents), h as (select sha256(text) as digest, count(*) as n from c where k > 1 group by 1 having count(*) > 1)
    select digest, n from h""")  # fmt: skip
def size_prefilter_dups(spark, sf_dir):
    return dedup.hash_groups(docs(spark, sf_dir, "doc_id", "text", "split", "n_chars"), "doc_id", "text", size="n_chars").select("digest", "n")


_COMPARE = f"""with {SQL_DOCS}, {SQL_ANN}, {SQL_DUP}, c as (select id_a, id_b, split_a, split_b, {relation_sql("split_a", "split_b")} as relation, case when x.boxes is null or y.boxes is null then 'missing_label' when x.boxes = y.boxes then 'exact_annotation'
    when len(x.boxes) <> len(y.boxes) then 'box_count_conflict' when list_sort(list_transform(x.boxes, lambda q: q.cls)) <> list_sort(list_transform(y.boxes, lambda q: q.cls)) then 'class_conflict' else 'geometry_conflict' end as result
    from dup join ann x on x.doc_id = id_a join ann y on y.doc_id = id_b)"""  # fmt: skip


def _annotated(spark, sf_dir):
    return annotations(docs(spark, sf_dir)).withColumn("sha", F.sha2("text", 256)).select("sha", "doc_id", "split", "boxes")


def _gone(spark, sf_dir):
    return dedup.member_removals(_annotated(spark, sf_dir), "sha", "doc_id")


def _compared(spark, sf_dir):
    pairs = dedup.member_pairs(_annotated(spark, sf_dir), "sha", "doc_id", ["split", "boxes"])
    return pairs.withColumn("result", dedup.compare_annotations(F.col("boxes_a"), F.col("boxes_b"))).withColumn("relation", s.relation("split_a", "split_b"))


@query("dup_pair_label_compare", f"{_COMPARE} select id_a, id_b, relation, result from c")
def dup_pair_label_compare(spark, sf_dir):
    return _compared(spark, sf_dir).select(F.col("doc_id_a").alias("id_a"), F.col("doc_id_b").alias("id_b"), "relation", "result")


@query("relation_result_matrix", f"{_COMPARE} select relation, result, count(*) as n from c group by 1, 2")
def relation_result_matrix(spark, sf_dir):
    return dedup.relation_matrix(_annotated(spark, sf_dir), "sha", "doc_id")


_DECIDED = f"""{_COMPARE}, r as (select *, case split_a when 'train' then 0 when 'val' then 1 else 2 end as ra, case split_b when 'train' then 0 when 'val' then 1 else 2 end as rb, result in ('exact_annotation','equivalent_annotation') as safe, split_a = split_b as same from c),
    d as (select relation, result, case when safe and same then 'safe_same_split_keep_lexical_canonical' when safe then 'safe_cross_split_keep_higher_priority' when same then 'conflict_same_split_quarantine_both' else 'conflict_cross_split_exclude_lower_quarantine_higher' end as action,
    case when (same and id_a < id_b) or (not same and ra > rb) then id_a else id_b end as high, case when (same and id_a < id_b) or (not same and ra > rb) then id_b else id_a end as low, safe, same, id_a, id_b from r),
    e as (select relation, result, action, case when safe then 'keep' else 'quarantine' end as role, high as doc_id from d where safe or not same union all select relation, result, action, 'exclude', low from d where safe or not same
    union all select relation, result, action, 'quarantine', id_a from d where not safe and same union all select relation, result, action, 'quarantine', id_b from d where not safe and same)"""  # fmt: skip


def _decided(spark, sf_dir):
    return dedup.decide(_compared(spark, sf_dir), key="doc_id")


@query("dedup_decisions", f"{_DECIDED} select relation, result, action, role, doc_id from e")
def dedup_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("relation", "result", "action", "role", "doc_id")


@query("manifest_accounting", f"""{_DECIDED}, gone as (select doc_id, max(role) as role from e where role <> 'keep' group by doc_id)
    select (select count(*) from documents) as n_original, (select count(*) from documents where doc_id not in (select doc_id from gone)) as n_clean, (select count(*) from gone where role='exclude') as n_exclude, (select count(*) from gone where role='quarantine') as n_quarantine, 0 as n_lost, 0 as n_overlap, 1 as holds""")  # fmt: skip
def manifest_accounting(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "split")
    gone = _gone(spark, sf_dir)
    parts = {"clean": manifest.without(d, gone, ("doc_id",)), "exclude": gone.where("role = 'exclude'"), "quarantine": gone.where("role = 'quarantine'")}
    sizes = manifest.stack({k: v.select("doc_id") for k, v in parts.items()}).agg(*(F.count_if(F.col("layer") == k).alias(f"n_{k}") for k in parts))
    out = manifest.accounting(d, parts, "doc_id").crossJoin(F.broadcast(sizes))
    return out.select("n_original", "n_clean", "n_exclude", "n_quarantine", F.col("n_lost").cast("int").alias("n_lost"), F.col("n_overlap").cast("int").alias("n_overlap"), F.col("holds").cast("int").alias("holds"))


@query("split_overlap_audit", f"with {SQL_DOCS} select sha256(text) as digest, count(*) as n, count(distinct split) as n_splits, string_agg(distinct split, '+' order by split) as splits from docs group by 1 having count(distinct split) > 1")
def split_overlap_audit(spark, sf_dir):
    d = docs(spark, sf_dir, "text", "split").withColumn("digest", F.sha2("text", 256))
    return manifest.overlap_audit(d, "digest").select("digest", "n", F.col("n_splits").cast("long").alias("n_splits"), F.array_join("splits", "+").alias("splits"))


@query("pairing_full_outer", """with l as (select doc_id + 300 as doc_id from labels), d as (select doc_id from documents), j as (select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'missing_label' when d.doc_id is null then 'missing_image' else 'paired' end as state from d full join l on d.doc_id = l.doc_id)
    select state, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from j group by state""")  # fmt: skip
def pairing_full_outer(spark, sf_dir):
    from ..operators.labels import pairing

    labels = read(spark, sf_dir, "labels").select((F.col("doc_id") + 300).alias("doc_id"))
    p = pairing(docs(spark, sf_dir, "doc_id"), labels, "doc_id")
    return p.groupBy("state").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


_HASHES = """h as (select vec_id, label, list_transform(embedding, lambda v: case when v > list_sort(embedding[2:64])[32] then 1 else 0 end) as bits from embeddings),
    p as (select a.vec_id as id_a, b.vec_id as id_b, a.label as label_a, b.label as label_b, cast(list_sum(list_transform(list_zip(a.bits, b.bits), lambda x: abs(x[1]-x[2]))) as int) as distance from h a join h b on a.vec_id < b.vec_id)"""


def sign_hashes(spark, sf_dir, *columns: str):
    """64-bit hashes of embeddings: bit i is set where the i-th value exceeds the median of all but the first."""
    e = read(spark, sf_dir, "embeddings")
    median = F.array_sort(F.slice("embedding", 2, 63))[31]
    # inside a lambda over one struct, so that the median is taken once a row and not once a value
    one = F.array(F.struct(F.col("embedding").alias("e"), median.alias("m")))
    packed = F.transform(one, lambda x: _pack(F.transform(x["e"], lambda v: (v > x["m"]).cast("int"))))
    return e.select("vec_id", "label", *columns, packed[0].alias("h"))


def _pack(bits):
    """Bits, the highest first, as a signed 64-bit integer: shifting never overflows."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint")))


@query("hamming_pairs", f"with {_HASHES} select id_a, id_b, distance from p where distance <= 20")
def hamming_pairs(spark, sf_dir):
    p = similarity.hamming_join(sign_hashes(spark, sf_dir), "h", 20, "vec_id")
    return p.select(F.col("vec_id_a").alias("id_a"), F.col("vec_id_b").alias("id_b"), F.col("distance").cast("int").alias("distance"))


@query("hamming_histogram", f"with {_HASHES} select label_a = label_b as same_label, distance, count(*) as n from p where distance <= 20 group by 1, 2")
def hamming_histogram(spark, sf_dir):
    n = similarity.distance_counts(sign_hashes(spark, sf_dir), "h", 20, "vec_id", "label")
    return n.select(F.col("same").alias("same_label"), "distance", "n")


@query("hamming_threshold_counts", f"with {_HASHES} select count(*) filter (where distance <= 16) as le_16, count(*) filter (where distance <= 18) as le_18, count(*) filter (where distance <= 20) as le_20 from p where distance <= 20")
def hamming_threshold_counts(spark, sf_dir):
    return similarity.threshold_counts(similarity.distance_counts(sign_hashes(spark, sf_dir), "h", 20, "vec_id"), "distance", [16, 18, 20], "n")


_METRICS = f"""with {_HASHES}, near as (select * from p where distance <= 20), m as (select n.*, a.embedding as ea, b.embedding as eb from near n join embeddings a on a.vec_id = id_a join embeddings b on b.vec_id = id_b),
    q as (select id_a, id_b, label_a, label_b, list_sum(list_transform(list_zip(ea, eb), lambda x: x[1]::double*x[2]::double)) as sab, list_sum(list_transform(ea, lambda x: x::double)) as sa, list_sum(list_transform(eb, lambda x: x::double)) as sb,
    list_sum(list_transform(ea, lambda x: x::double*x::double)) as saa, list_sum(list_transform(eb, lambda x: x::double*x::double)) as sbb, list_sum(list_transform(list_zip(ea, eb), lambda x: abs(x[1]::double-x[2]::double)))/64 as mae,
    list_sum(list_transform(list_zip(ea, eb), lambda x: (x[1]::double-x[2]::double)**2))/64 as mse from m),
    r as (select id_a, id_b, label_a, label_b, (sab-sa*sb/64)/sqrt((saa-sa*sa/64)*(sbb-sb*sb/64)) as corr, mae, case when mse <= 0 then 999.0 else 10*log10(1/mse) end as psnr from q)"""  # fmt: skip


def _metrics(spark, sf_dir):
    return similarity.hamming_metrics(sign_hashes(spark, sf_dir, "embedding"), "h", 20, "vec_id", "embedding", ["label"])


@query("pair_metrics", f"{_METRICS} select id_a, id_b, round(corr, 6) as corr, round(mae, 6) as mae, round(psnr, 5) as psnr from r")
def pair_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select(F.col("vec_id_a").alias("id_a"), F.col("vec_id_b").alias("id_b"), F.round("corr", 6).alias("corr"), F.round("mae", 6).alias("mae"), F.round("psnr", 5).alias("psnr"))


_LOOSE = {"tight": {"corr": 0.45, "mae": 0.12, "color": 20.0}, "middle": {"corr": 0.35, "mae": 0.13, "color": 18.0}, "wide": {"corr": 0.20, "mae": 0.20, "color": 15.0}}


@query("gate_profile", f"""{_METRICS}, g as (select case when label_a = label_b then 'same_label' else 'cross_label' end as relation, unnest(list_filter([{", ".join(f"case when corr >= {v['corr']} and mae <= {v['mae']} and psnr >= {v['color']} then '{k}' end" for k, v in _LOOSE.items())}], lambda x: x is not null)) as gate from r),
    c as (select *, relation not like 'same_%' as crosses from g)
    select gate, null as relation, null as crosses, count(*) as n from c group by gate union all select gate, relation, null, count(*) from c group by gate, relation union all select gate, null, crosses, count(*) from c group by gate, crosses""")  # fmt: skip
def gate_profile(spark, sf_dir):
    n = similarity.gate_counts(sign_hashes(spark, sf_dir, "embedding"), "h", 20, "vec_id", "embedding", _LOOSE, "label")
    rows = n.select(F.array("gate").alias("gates"), F.when(F.col("same"), "same_label").otherwise("cross_label").alias("relation"), "n")
    return similarity.gate_profile(rows, weight="n").select("gate", "relation", F.col("cross").alias("crosses"), "n")


_SEQ = """n as (select c_custkey as k, c_name as name, c_custkey % 3 as b, c_acctbal as a from customer), q as (select x.k as k_a, y.k as k_b, x.name as na, y.name as nb, regexp_extract(x.name, '^(.*?)([0-9]+)$', 1) as pa, regexp_extract(y.name, '^(.*?)([0-9]+)$', 1) as pb, cast(regexp_extract(x.name, '^(.*?)([0-9]+)$', 2) as bigint) as ia, cast(regexp_extract(y.name, '^(.*?)([0-9]+)$', 2) as bigint) as ib, x.b as ba, y.b as bb, x.a as aa, y.a as ab from n x join n y on y.k = x.k + 1 + (x.k % 9))"""


@query("filename_sequence", f"with {_SEQ} select k_a, k_b, pa = pb as same_prefix, case when pa = pb then abs(ia - ib) end as index_gap, coalesce(pa = pb and abs(ia - ib) <= 5, false) as close_index from q")
def filename_sequence(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    other = c.select(F.col("k").alias("k_b"), F.col("name").alias("nb"))
    pairs = c.withColumn("k_b", F.col("k") + 1 + F.col("k") % 9).join(other, "k_b").select(F.col("k").alias("k_a"), "k_b", "name", "nb")
    return pairs.select("k_a", "k_b", s.filename_sequence("name", "nb").alias("q")).select("k_a", "k_b", "q.*")


@query("manifest_content_hash", f"with {SQL_DOCS}, n as (select distinct split, printf('%08d', doc_id) as name from docs) select split, sha256(string_agg(name, chr(10) order by name) || chr(10)) as sha256, count(*) as n from n group by split")
def manifest_content_hash(spark, sf_dir):
    d = docs(spark, sf_dir, "split", F.format_string("%08d", "doc_id").alias("name"))
    return manifest.content_hash(d, "name")


_SCORE = """p as (select *, (id_a % 10) / 10.0 as a, (id_b % 10) / 10.0 as b, (id_a + id_b) % 5 as consensus from c)"""


@query("adjudicate", f"""{_COMPARE}, {_SCORE}, z as (select id_a, id_b, relation, case when relation like '%test%' then 'BENCHMARK_QUARANTINE' when result = 'class_conflict' then 'CLASS_CONFLICT_REVIEW' when consensus = 0 then 'TEACHER_UNCERTAIN' when a >= 0.6 and a-b >= 0.15 then 'A_STRONG' when b >= 0.6 and b-a >= 0.15 then 'B_STRONG' when a >= 0.6 and b >= 0.6 and abs(a-b) <= 0.1 then 'BOTH_REASONABLE' else 'TEACHER_UNCERTAIN' end as decision from p)
    select id_a, id_b, decision, relation = 'same_train' and decision in ('A_STRONG','B_STRONG') as eligible from z""")  # fmt: skip
def adjudicate(spark, sf_dir):
    c = _compared(spark, sf_dir).select(F.col("doc_id_a").alias("id_a"), F.col("doc_id_b").alias("id_b"), "relation", "result")
    c = c.withColumns({"a": (F.col("id_a") % 10) / 10, "b": (F.col("id_b") % 10) / 10, "consensus": (F.col("id_a") + F.col("id_b")) % 5})
    c = c.withColumn("decision", s.adjudicate("relation", "result", "a", "b", "consensus"))
    return c.select("id_a", "id_b", "decision", s.recovery_eligible("relation", "decision").alias("eligible"))
