"""Ranks, quotas, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..operators import dedup, manifest, mining, sampling
from .base import SQL_DOCS, docs, query, read


@query("stratified_topk", "with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('R1|' || doc_id), doc_id) as rank from documents) select * from r where rank <= 40")
def stratified_topk(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang")
    return sampling.top_k(d, ["lang"], [s.stable_rank("doc_id", salt="R1|"), F.col("doc_id")], 40).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


_SOFT = f"""with {SQL_DOCS}, x as (select doc_id, lang, sha256(text) as key, n_chars % 50 as score, n_chars % 97 = 0 as rare, sha256('R1|' || doc_id) as h from docs),
    a as (select *, row_number() over (partition by lang, key order by score desc, h, doc_id) as nth from x), b as (select *, nth > 1 and not rare as deferred from a), c as (select *, row_number() over (partition by lang order by deferred, score desc, h, doc_id) as rank from b)"""


@query("soft_diversity_topk", f"{_SOFT} select doc_id, lang, rank, deferred from c where rank <= 100")
def soft_diversity_topk(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", "text", "n_chars").select("doc_id", "lang", F.sha2("text", 256).alias("key"), (F.col("n_chars") % 50).alias("score"), (F.col("n_chars") % 97 == 0).alias("rare"), s.stable_rank("doc_id", salt="R1|").alias("h"))
    out = sampling.soft_diverse_top_k(d, "lang", [F.desc("score"), F.col("h"), F.col("doc_id")], ["key"], 100, F.col("rare"))
    return out.select("doc_id", "lang", F.col("rank").cast("long").alias("rank"), "deferred")


_HAM = """with n as (select quality, toxic, count(*) as n from labels group by 1, 2), t as (select round_even(sum(n) * 0.2, 0) as total, sum(n) as everything from n),
    q as (select quality, toxic, n, floor(n * total / everything) as base, n * total / everything - floor(n * total / everything) as frac, total from n, t),
    r as (select *, total - sum(base) over () as rest, row_number() over (order by frac desc, quality || '|' || toxic) as k from q), tg as (select quality, toxic, n, cast(least(n, base + case when k <= rest then 1 else 0 end) as bigint) as target from r)"""


@query("hamilton_targets", f"{_HAM} select * from tg")
def hamilton_targets(spark, sf_dir):
    n = read(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return sampling.hamilton_targets(n, F.bround(F.col("_all") * 0.2), ["quality", "toxic"])


@query("hamilton_split", f"{_HAM}, k as (select l.doc_id, l.quality, l.toxic, row_number() over (partition by l.quality, l.toxic order by sha256('42:' || doc_id), doc_id) as k from labels l) select k.doc_id, k.k <= tg.target as held_out from k join tg using (quality, toxic)")
def hamilton_split(spark, sf_dir):
    return sampling.hamilton_split(read(spark, sf_dir, "labels"), ["quality", "toxic"], 0.2, "doc_id", "42:").select("doc_id", "held_out")


_EVEN = "with e as (select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as i, count(*) over (partition by event_type) as n from events), k as (select unnest(range(0, 25)) as k)"


@query("even_sample", f"{_EVEN} select distinct event_id, event_type from e join k on i = cast(round_even(k * ((n - 1) / 24.0), 0) as bigint) where n > 25 union select event_id, event_type from e where n <= 25")
def even_sample(spark, sf_dir):
    return sampling.evenly_spaced(read(spark, sf_dir, "events"), "event_type", [F.col("ts"), F.col("event_id")], 25).select("event_id", "event_type")


@query("even_sample_truncated", f"{_EVEN} select distinct event_id, event_type from e join k on i = cast(floor(k * ((n - 1) / 24.0)) as bigint) where n > 25 union select event_id, event_type from e where n <= 25")
def even_sample_truncated(spark, sf_dir):
    return sampling.evenly_spaced(read(spark, sf_dir, "events"), "event_type", [F.col("ts"), F.col("event_id")], 25, truncate=True).select("event_id", "event_type")


@query("round_robin_quota", """with c as (select lang, count(*) as capacity, row_number() over (order by lang) as ord from documents group by lang), b as (select *, least(capacity, 130) as base, capacity - least(capacity, 130) as spare from c), m as (select greatest(0, 520 - sum(base)) as missing from b),
    x as (select lang, ord, unnest(range(1, cast(least(spare, 520) as bigint) + 1)) as k from b where spare > 0), d as (select lang, row_number() over (order by k, ord) as r from x), e as (select lang, count(*) as extra from d, m where r <= missing group by lang)
    select b.lang, cast(base + coalesce(extra, 0) as bigint) as quota from b left join e using (lang)""")  # fmt: skip
def round_robin_quota(spark, sf_dir):
    c = docs(spark, sf_dir, "lang").groupBy("lang").agg(F.count("*").alias("capacity"))
    c = dedup.with_rank(c, [F.col("lang")], "ord")
    return sampling.water_fill(c, "lang", 130, 520)


@query("first_per_hash", "with r as (select doc_id, lang, row_number() over (partition by text order by lang, doc_id) as r from documents), f as (select doc_id, lang from r where r = 1) select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as index from f")
def first_per_hash(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", F.sha2("text", 256).alias("sha"))
    first = dedup.first_per_hash(d, "sha", ["lang", "doc_id"]).select("doc_id", "lang")
    return sampling.running_index(first, "lang", ["doc_id"]).withColumn("index", F.col("index").cast("long"))


@query("replay_oversample", """with x as (select doc_id, sha256('42:r:' || doc_id) as h, case when n_chars < 500 then 'small' when lang = 'de' then 'german' when lang = 'en' then 'general' end as stratum from documents),
    r as (select *, row_number() over (partition by stratum order by h, doc_id) as k from x where stratum is not null), t as (select doc_id, stratum, unnest(range(1, case stratum when 'small' then 3 else 2 end)) as repeat from r where (stratum = 'small') or (stratum = 'german' and k <= 60) or (stratum = 'general' and k <= 100)) select * from t""")  # fmt: skip
def replay_oversample(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", "n_chars")
    strata = [("small", F.col("n_chars") < 500, None, 2), ("german", F.col("lang") == "de", 60, 1), ("general", F.col("lang") == "en", 100, 1)]
    out = sampling.replay(d, strata, [s.stable_rank("doc_id", salt="42:r:"), F.col("doc_id")])
    return out.select("doc_id", "stratum", F.col("repeat").cast("long").alias("repeat"))


@query("group_holdout", """with u as (select distinct user_id from events), r as (select user_id, row_number() over (order by sha256('42:' || user_id), user_id) as k, count(*) over () as n from u)
    select k <= floor(n * 0.2) as held_out, count(*) as n, count(distinct user_id) as users from events join r using (user_id) group by 1""")  # fmt: skip
def group_holdout(spark, sf_dir):
    e = sampling.group_hold_out(read(spark, sf_dir, "events"), "user_id", share=0.2)
    return e.groupBy("held_out").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("hash_sample", "with r as (select doc_id, source, row_number() over (partition by source order by sha256('review:' || doc_id), doc_id) as k from documents) select doc_id, source from r where k <= 5")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(docs(spark, sf_dir, "doc_id", "source"), ["source"], 5, "doc_id", "review:")


@query("top_up", """with d as (select doc_id, lang, sha256(text) as h from documents), c as (select h from d where doc_id % 10 < 7), f as (select * from d where h not in (select h from c)), o as (select *, row_number() over (partition by h order by lang, doc_id) as k from f),
    t as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as k from o where k = 1) select doc_id, lang from t order by k, lang limit 50""")  # fmt: skip
def top_up(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang", F.sha2("text", 256).alias("h"))
    return sampling.top_up(d, d.where("doc_id % 10 < 7"), "lang", "h", ["doc_id"], "lang", 50).select("doc_id", "lang")


@query("most_common", "select source, count(*) as n from documents where lang <> 'en' group by 1 order by n desc, source limit 10")
def most_common(spark, sf_dir):
    return docs(spark, sf_dir, "source", "lang").where("lang <> 'en'").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("set_algebra", f"with {SQL_DOCS}, t as (select distinct sha256(text) as h from docs where split='train'), v as (select distinct sha256(text) as h from docs where split='val') select (select count(*) from (select h from t union select h from v)) as n_union, (select count(*) from (select h from t intersect select h from v)) as n_both, (select count(*) from (select h from t except select h from v)) as n_train_only")
def set_algebra(spark, sf_dir):
    d = docs(spark, sf_dir, "split", F.sha2("text", 256).alias("h"))
    t, v = (d.where(F.col("split") == x).select("h").distinct() for x in ("train", "val"))
    tagged = t.withColumn("t", F.lit(1)).join(v.withColumn("v", F.lit(1)), "h", "full")
    return tagged.agg(F.count("*").alias("n_union"), F.count_if(F.col("t").isNotNull() & F.col("v").isNotNull()).alias("n_both"), F.count_if(F.col("v").isNull()).alias("n_train_only"))


@query("unseen_pool", "with n as (select doc_id from labels where toxic = 0), used as (select doc_id from documents where doc_id % 3 = 0) select doc_id from n where doc_id not in (select doc_id from used)")
def unseen_pool(spark, sf_dir):
    negatives = read(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    return manifest.without(negatives, docs(spark, sf_dir, "doc_id").where("doc_id % 3 = 0"), ("doc_id",))


@query("foreign_keys", "select (select count(*) from labels where doc_id + 300 in (select doc_id from documents)) as known, (select count(distinct doc_id + 300) from labels where doc_id + 300 not in (select doc_id from documents)) as missing")
def foreign_keys(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select((F.col("doc_id") + 300).alias("doc_id"))
    known, missing = manifest.foreign_keys(labels, docs(spark, sf_dir, "doc_id"), "doc_id")
    return known.agg(F.count("*").alias("known")).crossJoin(F.broadcast(missing.agg(F.count("*").alias("missing"))))


@query("dataset_union", "with u as (select doc_id, 'base' as part from documents where doc_id % 2 = 0 union all select doc_id, 'hard' from labels where toxic = 1) select part, count(*) as n, count(distinct doc_id) as n_distinct from u group by 1")
def dataset_union(spark, sf_dir):
    base = docs(spark, sf_dir, "doc_id").where("doc_id % 2 = 0")
    hard = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    u = manifest.stack({"base": base, "hard": hard})
    return u.groupBy(F.col("layer").alias("part")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query("frozen_identity", f"with {SQL_DOCS}, a as (select split, count(*) as n from docs group by 1), b as (select split, count(*) as n from docs where doc_id <> 0 group by 1) select split, a.n as now, b.n as frozen, case when a.n = b.n then 'same' else 'changed' end as state from a join b using (split)")
def frozen_identity(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "split")
    n = lambda x: x.groupBy("split").agg(F.count("*").alias("n"))
    return manifest.frozen_identity(n(d), n(d.where("doc_id <> 0")), ["split"], "n")


@query("inclusion_rules", """with x as (select doc_id, lang, case doc_id % 5 when 0 then ' Approve ' when 1 then 'relabel' when 2 then 'skip' end as status from documents), y as (select doc_id, lang, case when lower(trim(status)) in ('approve','relabel','quarantine') then lower(trim(status)) end as status from x)
    select case when lang in ('en','fr') then 'category' when status = 'approve' then 'approved' else 'not_approved' end as why, count(*) as n from y group by 1""")  # fmt: skip
def inclusion_rules(spark, sf_dir):
    d = docs(spark, sf_dir, F.col("doc_id").alias("image"), F.col("lang").alias("category"))
    said = d.select("image", F.expr("case image % 5 when 0 then ' Approve ' when 1 then 'relabel' when 2 then 'skip' end").alias("status"))
    return mining.included(mining.review_decisions(d, said), ["en", "fr"]).groupBy("why").agg(F.count("*").alias("n"))


@query("filename_categories", """with n as (select case c_custkey % 6 when 0 then 'bothFireAndSmoke_' when 1 then 'Fire_' when 2 then 'smoke_' when 3 then 'x_neitherfire' when 4 then 'a_val_' else 'plain' end || c_name as stem from customer), l as (select lower(stem) as s, stem from n)
    select case when s like 'bothfireandsmoke%' then 'fire_smoke' when s like 'fire%' then 'fire_only' when s like 'smoke%' then 'smoke_only' when s like '%neither%' or s like '%negative%' or s like '%nofire%' then 'negative' else 'other' end as category, case when len(string_split(stem, '_')) >= 3 then string_split(stem, '_')[2] else 'unknown' end as split, count(*) as n from l group by 1, 2""")  # fmt: skip
def filename_categories(spark, sf_dir):
    head = "case c_custkey % 6 when 0 then 'bothFireAndSmoke_' when 1 then 'Fire_' when 2 then 'smoke_' when 3 then 'x_neitherfire' when 4 then 'a_val_' else 'plain' end"
    n = read(spark, sf_dir, "customer").select(F.concat(F.expr(head), "c_name").alias("stem"))
    return n.groupBy(s.semantic_category("stem").alias("category"), s.split_of_name("stem").alias("split")).agg(F.count("*").alias("n"))
