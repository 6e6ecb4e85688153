"""Queries that write files and read them back, and column functions on made-up names and counts.

Files that stand for a data set on disk are a few, one for each row of the nation table.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scoring as s
from ..operators import dedup, labels, manifest, mining
from ..sources import readers, schemas, sinks
from ..streaming import incremental
from .base import SQL_BOX, SQL_DOCS, boxes, docs, query, read
from .queries_leakage import _IMG, hashed_items
from .storage import new_path


def _put(spark: SparkSession, path: str, content: bytes | str) -> None:
    """One small file, written by the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def _nations(spark, sf_dir) -> list:
    return read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def _tree(spark, sf_dir) -> str:
    """Label texts by region; every fourth nation's is blank; every fifth nation has a picture of two kinds."""
    top = new_path(spark, "tree")
    for n in _nations(spark, sf_dir):
        k, folder = n.n_nationkey, f"{top}/r{n.n_regionkey}"
        _put(spark, f"{folder}/n{k}.txt", " \n" if k % 4 == 0 else f"{k % 2} 0.5 0.5 0.1 0.1 {n.n_name}\n")
        if k % 5 == 0:
            _put(spark, f"{folder}/n{k}.png", f"picture {k}")
            _put(spark, f"{top}/other/n{k}.jpg", f"picture {k if k % 10 else 'x'}")
    return top


_TEXT = "case when n_nationkey % 4 = 0 then ' ' || chr(10) else cast(n_nationkey % 2 as varchar) || ' 0.5 0.5 0.1 0.1 ' || n_name || chr(10) end"


@query("file_inventory", f"select 'n' || n_nationkey as stem, '.txt' as ext, cast(length({_TEXT}) as bigint) as length from nation union all select 'n' || n_nationkey, '.png', length('picture ' || n_nationkey) from nation where n_nationkey % 5 = 0 union all select 'n' || n_nationkey, '.jpg', length('picture ' || case when n_nationkey % 10 = 0 then 'x' else cast(n_nationkey as varchar) end) from nation where n_nationkey % 5 = 0")
def file_inventory(spark, sf_dir):
    return readers.files(spark, _tree(spark, sf_dir), recursive=True).select("stem", "ext", "length")


@query("stem_conflicts", "select 'n' || n_nationkey as stem, 2 as n, '.jpg' as ext, n_nationkey % 10 = 0 as conflict from nation where n_nationkey % 5 = 0")
def stem_conflicts(spark, sf_dir):
    """Stems with several pictures, which file is taken, and whether the files differ."""
    found = readers.images(spark, _tree(spark, sf_dir), recursive=True, content=True)
    index, double = readers.stem_index(found)
    taken = readers.resolve_stems(index.select("stem").distinct(), found)
    return double.join(taken, "stem").select("stem", F.col("n").cast("int").alias("n"), s.path_extension("path").alias("ext"), "conflict")


@query("label_file_texts", f"select 'n' || n_nationkey as stem, cast(length({_TEXT}) as bigint) as n, n_nationkey % 4 = 0 as empty from nation")
def label_file_texts(spark, sf_dir):
    top = _tree(spark, sf_dir)
    texts = readers.label_texts(spark, [f"{top}/r{i}" for i in range(read(spark, sf_dir, "region").count())])
    empty = labels.empty_labels(texts).select("stem", F.lit(True).alias("empty"))
    return texts.join(empty, "stem", "left").select("stem", F.length("text").cast("long").alias("n"), F.coalesce("empty", F.lit(False)).alias("empty"))


_STEM = "printf('d%09d', doc_id)"


@query("manifest_round_trip", f"with {SQL_DOCS} select split, '/data/images/' || {_STEM} || '.jpg' as entry, {_STEM} as stem from docs where split <> 'train'")
def manifest_round_trip(spark, sf_dir):
    names = docs(spark, sf_dir, "split", F.format_string("/data/images/d%09d.jpg", "doc_id").alias("entry"))
    out = {}
    for split in ("val", "test"):
        path = new_path(spark, split)
        sinks.write_manifest(names.where(F.col("split") == split), path, "entry")
        out[split] = readers.split_list(spark, path, split)
    return out["val"].unionByName(out["test"])


@query("manifest_repeats", "with m as (select source as stem from documents union all select '# ' || lang from documents) select stem, count(*) as n from m where stem not like '#%' group by 1 having count(*) > 1")
def manifest_repeats(spark, sf_dir):
    path = new_path(spark, "list")
    d = docs(spark, sf_dir, "source", "lang")
    d.select(F.explode(F.array(F.concat(F.lit("/x/"), "source", F.lit(".jpg")), F.concat(F.lit("# "), "lang"), F.lit(" "))).alias("value")).write.text(path)
    return readers.manifest_repeats(spark, path)


@query("manifest_checks", f"with {SQL_DOCS} select (select count(distinct source) from docs where split = 'test' and source not in (select source from docs where split = 'train')) as strays, (select count(distinct {_STEM}) from docs where split = 'test') as strangers, count(distinct source) as n, count(distinct source) = 20 as holds from docs")
def manifest_checks(spark, sf_dir):
    """Is every test source (and every test item) one of train's, and are there as many sources as expected?"""
    path = new_path(spark, "sources")
    d = docs(spark, sf_dir, "doc_id", "source", "split")
    d.select(F.explode(F.array(F.lit("# all sources"), F.col("source"))).alias("value")).write.text(path)
    known = readers.manifest(spark, path, comments=True)
    of = lambda split, c: d.where(F.col("split") == split).select(F.col(c).alias("stem"))
    strays = manifest.subset_violations(of("test", "source"), of("train", "source")).agg(F.count("*").alias("strays"))
    strangers = manifest.subset_violations(of("test", "doc_id"), of("train", "doc_id")).agg(F.count("*").alias("strangers"))
    return strays.crossJoin(strangers).crossJoin(manifest.expect_count(known, 20).select("n", "holds"))  # one row each


_SIGNED = "cast(case when {0} >= 9223372036854775808 then {0}::hugeint - 18446744073709551616 else {0}::hugeint end as bigint)"


@query("hash_table_round_trip", f"with {SQL_DOCS}, {_IMG} select stem, split, cast(printf('%.3f', aspect) as double) as aspect, {_SIGNED.format('p')} as p, {_SIGNED.format('d')} as d from img where split = 'val'")
def hash_table_round_trip(spark, sf_dir):
    """Hashes as a CSV of fixed columns and digits, read by schema; the filter on the split reaches the scan."""
    path = new_path(spark, "hashes")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    rows = hashed_items(spark, sf_dir).withColumns({"phash": hexed("p"), "dhash": hexed("d"), "width": F.lit(640), "height": F.lit(480)})
    names = [c.split()[0] for c in schemas.HASHES.split(", ")]
    sinks.write_csv(rows, path, names, {"aspect": 3})
    return readers.hashes(spark, path).where("split = 'val'").select("stem", "split", "aspect", "p", "d")


@query("detection_cache", f"with {SQL_BOX} select cls as class_id, count(*) as n, count(distinct img) as images, round(sum(conf), 4) as conf, round(min(x1), 8) as left_most from box where side = 'O' group by 1")
def detection_cache(spark, sf_dir):
    """Predictions as JSON lines, one an image, and read back as rows."""
    path = new_path(spark, "cache")
    b = boxes(spark, sf_dir, numbered=False).where("side = 'O'")
    corner = F.array(*(F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")))
    one = F.struct(F.col("cls").alias("class_id"), F.col("conf").alias("confidence"), corner.alias("xyxy"))
    sinks.write_jsonl(b.groupBy(F.col("img").cast("string").alias("image")).agg(F.collect_list(one).alias("predictions")), path)
    d = readers.detections(spark, path, "n").withColumn("box", g.corners_of_array("xyxy"))
    return d.groupBy("class_id").agg(F.count("*").alias("n"), F.count_distinct("image").alias("images"), F.round(F.sum("confidence"), 4).alias("conf"), F.round(F.min("box.x1"), 8).alias("left_most"))


@query("report_round_trip", "select count(*) as n, count(distinct lang) as langs, max(doc_id) as last from documents")
def report_round_trip(spark, sf_dir):
    path = new_path(spark, "report")
    sinks.write_report(docs(spark, sf_dir, "doc_id", "lang").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.max("doc_id").alias("last")), path)
    return readers.json_document(spark, path, "n long, langs long, last long")


def _archive(nations) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in nations:
            k = n.n_nationkey
            z.writestr(f"labels/n{k}.txt", f"{k % 2} 0.5 0.5 0.1 0.1")
            z.writestr(f"xml/n{k}.xml", f"<annotation><object><name>{n.n_name}</name></object>{'<object><name>smoke</name></object>' * (k % 3)}</annotation>")
            z.writestr(f"coco/n{k}.json", json.dumps({"images": [{"id": i} for i in range(k)], "annotations": [{"id": 1, "category_id": 2}], "categories": [{"id": 2, "name": "smoke"}, {"id": 1, "name": n.n_name}]}))
            z.writestr(f"big/n{k}.txt", "y" * 5000)
    return out.getvalue()


def _members(spark, sf_dir):
    path = new_path(spark, "archives")
    nations = _nations(spark, sf_dir)
    for r in sorted({n.n_regionkey for n in nations}):
        _put(spark, f"{path}/r{r}.zip", _archive([n for n in nations if n.n_regionkey == r]))
    return readers.zip_members(spark, path, [".txt", ".xml", ".json"], most_bytes=4000, contents=True).withColumns({"archive": s.path_stem("archive"), "stem": s.path_stem("member"), "ext": s.path_extension("member")})


@query("archive_members", "select 'r' || n_regionkey as archive, 'labels/n' || n_nationkey || '.txt' as member, length('0 0.5 0.5 0.1 0.1')::int as size from nation")
def archive_members(spark, sf_dir):
    return _members(spark, sf_dir).where("ext = '.txt'").select("archive", "member", F.col("size").cast("int").alias("size"))


@query("archive_annotations", "select 'n' || n_nationkey as stem, n_name || repeat(',smoke', n_nationkey % 3) as names, cast(n_nationkey as int) as n_images, 1 as n_annotations, n_name || ',smoke' as categories from nation")
def archive_annotations(spark, sf_dir):
    m = _members(spark, sf_dir)
    voc = m.where("ext = '.xml'").select("stem", F.array_join(readers.voc_classes("text"), ",").alias("names"))
    coco = readers.coco_summary(m.where("ext = '.json'").select("stem", "text")).select("stem", "n_images", "n_annotations", F.array_join("categories", ",").alias("categories"))
    return voc.join(coco, "stem")


def _png(width: int, height: int) -> bytes:
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    rows = b"".join(b"\0" + bytes([width, 20, 30] * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@query("decoded_pictures", "select 'n' || n_nationkey as stem, case when n_nationkey % 6 <> 0 then n_nationkey + 4 end as width, case when n_nationkey % 6 <> 0 then 7 end as height, case when n_nationkey % 6 <> 0 then 3 end as channels, n_nationkey % 6 <> 0 as valid from nation")
def decoded_pictures(spark, sf_dir):
    path = new_path(spark, "pictures")
    for n in _nations(spark, sf_dir):
        _put(spark, f"{path}/n{n.n_nationkey}.png", _png(n.n_nationkey + 4, 7) if n.n_nationkey % 6 else "no picture")
    good = readers.valid_images(spark, path).select("path", F.lit(True).alias("valid"))
    return readers.decoded_images(spark, path).join(good, "path", "left").select("stem", "width", "height", "channels", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("lists_by_severity", "select lang as severity, count(*) as n, min(doc_id) as first from documents group by 1")
def lists_by_severity(spark, sf_dir):
    path = new_path(spark, "by")
    sinks.write_by(docs(spark, sf_dir, "doc_id", F.col("lang").alias("severity")), path, "severity")
    return spark.read.option("header", True).schema("doc_id long, severity string").csv(path).groupBy("severity").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("copy_plan", f"with {SQL_DOCS} select {_STEM} as stem, '/in/' || {_STEM} || '.jpg' as source, '/out/' || split || '/' || {_STEM} || '.jpg' as target from docs where split <> 'train'")
def copy_plan(spark, sf_dir):
    d = docs(spark, sf_dir, F.format_string("d%09d", "doc_id").alias("stem"), "split")
    index = d.select("stem", F.concat(F.lit("/in/"), "stem", F.lit(".jpg")).alias("path"))
    return sinks.copy_plan(d.where("split <> 'train'"), index, "/out/")


@query("dataset_contract", "with n as (select row_number() over (order by lang) - 1 as id, lang as name from (select distinct lang from documents)) select cast(id as int) as id, name, true as listed from n")
def dataset_contract(spark, sf_dir):
    """Class names written to a data file, read back in order, and whether the file lists each."""
    path, names = new_path(spark, "data"), sorted(r.lang for r in docs(spark, sf_dir, "lang").where("lang is not null").distinct().collect())
    _put(spark, f"{path}/data.yaml", sinks.data_yaml("/data", names))
    text = spark.read.text(f"{path}/data.yaml", wholetext=True).first().value
    lines = spark.read.text(f"{path}/data.yaml").select(F.trim("value").alias("line"))
    back = spark.createDataFrame(list(enumerate(readers.class_contract(text))), "id int, name string")
    return back.join(lines, F.concat_ws(": ", F.col("id").cast("string"), "name") == F.col("line"), "left").select("id", "name", F.col("line").isNotNull().alias("listed"))


@query("summary_lines", "with c as (select event_type, count(*) as n from events group by 1) select rpad(event_type, 40, '.') || ' ' || n as line from c")
def summary_lines(spark, sf_dir):
    return sinks.summary_lines(read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


@query("locked_record", "select count(*) as n, true as refused from documents")
def locked_record(spark, sf_dir):
    """A record is written once; a second write is refused and changes nothing."""
    from pyspark.errors import AnalysisException

    path, record = new_path(spark, "lock"), docs(spark, sf_dir, "doc_id").agg(F.count("*").alias("n"))
    sinks.write_lock(spark, path, record)
    try:
        sinks.write_lock(spark, path, record.select((F.col("n") + 1).alias("n")))
        refused = False
    except AnalysisException:
        refused = True
    return readers.json_document(spark, path, "n long").withColumn("refused", F.lit(refused))


@query("resumed_chunks", "select 0 as missing, 0 as foreign, 0 as repeated, true as complete, sum(n_chars) as chars from documents where lang is not null")
def resumed_chunks(spark, sf_dir):
    """Files taken in chunks by a stream that stops after half of them, resumes, and is then asked for what it has done."""
    d = docs(spark, sf_dir, "doc_id", "lang", "n_chars").where("lang is not null")
    top = {x: new_path(spark, x) for x in ("source", "target", "checkpoint", "stage")}
    half = F.pmod("doc_id", F.lit(2))
    run = lambda: incremental.process_files(spark, top["source"], "doc_id long, lang string, n_chars long", lambda b: b.select("doc_id", "n_chars"), top["target"], top["checkpoint"], 1).awaitTermination()
    for k in (0, 1):
        d.where(half == k).repartition(2, "doc_id").write.mode("append").parquet(top["source"])
        run()
    run()  # nothing is left to do
    done = incremental.run_once(spark, top["stage"], lambda: incremental.results(spark, top["target"]))
    chars = done.agg(F.sum("n_chars").alias("chars"))
    out = incremental.complete(done, d, "doc_id").crossJoin(chars)  # one row each
    return out.select(*(F.col(c).cast("int").alias(c) for c in ("missing", "foreign", "repeated")), "complete", "chars")


@query("duplicate_members", f"with {SQL_DOCS} select sha256(text) as digest, doc_id, split from docs where text in (select text from docs group by 1 having count(*) > 1)")
def duplicate_members(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text", "split")
    return dedup.group_members(d, dedup.hash_groups(d, "doc_id", "text"), "doc_id", "text")


@query("inventory_hashes", f"with {SQL_DOCS}, {_IMG} select docs.doc_id, n_chars, coalesce(printf('%016x', h.p), '') as phash, coalesce(printf('%016x', h.d), '') as dhash from docs left join (select * from img where doc_id % 3 <> 0) h using (doc_id)")
def inventory_hashes(spark, sf_dir):
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(f"{c}hash")
    known = hashed_items(spark, sf_dir).where("doc_id % 3 <> 0").select("doc_id", hexed("p"), hexed("d"))
    return labels.with_hashes(docs(spark, sf_dir, "doc_id", "n_chars"), known, key="doc_id")


@query("review_queue", "with c as (select doc_id, quality, 1 as turn from labels union all select doc_id, toxic + 2, 2 from labels where toxic is not null and doc_id % 2 = 0), l as (select doc_id, max_by(quality, turn) as v from c group by 1) select doc_id as image, case when l.v is null then 'pending' else 'set ' || l.v end as status, case when l.v is null then '' else 'reviewed' end as note from documents left join l using (doc_id)")
def review_queue(spark, sf_dir):
    queue = docs(spark, sf_dir, F.col("doc_id").alias("image")).withColumns({"status": F.lit("pending"), "note": F.lit("")})
    marks = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "image")
    told = lambda v, at: (F.concat(F.lit("set "), v.cast("string")).alias("status"), F.lit("reviewed").alias("note"), F.lit(at).alias("at"))
    changes = marks.select("image", *told(F.col("quality"), 1)).unionByName(marks.where("toxic is not null and image % 2 = 0").select("image", *told(F.col("toxic") + 2, 2)))
    return mining.update_queue(queue, changes)


@query("event_times", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at from events")
def event_times(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", s.iso_time("ts").alias("at"))


@query("pixel_corners", f"with {SQL_BOX} select bid, round(x1 * 640, 6) as x1, round(y1 * 480, 6) as y1, round(x2 * 640, 6) as x2, round(y2 * 480, 6) as y2, 1 - cls as cls from box")
def pixel_corners(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("p", g.corners("xc", "yc", "w", "h", F.lit(640.0), F.lit(480.0)))
    return b.select("bid", *(F.round(f"p.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")), g.remapped_class("cls").alias("cls"))


_FIRST_IOU = "greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1))"


@query("iou_with_first", f"with {SQL_BOX}, p as (select a.img, b.bid, {_FIRST_IOU} as common, greatest(0,a.x2-a.x1)*greatest(0,a.y2-a.y1) + greatest(0,b.x2-b.x1)*greatest(0,b.y2-b.y1) as area from box a join box b on a.img = b.img and a.bid % 100000 = 0) select img, count(*) as n, round(max(case when area - common <= 0 then 0 else common / (area - common) end), 8) as best, round(sum(case when area - common <= 0 then 0 else common / (area - common) end), 6) as total from p group by 1")
def iou_with_first(spark, sf_dir):
    """IoU of each image's first box with all boxes of the image, by one vectorised expression."""
    per = boxes(spark, sf_dir).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("bid", "box"))).alias("b"))
    each = g.iou_with_each(F.col("b")[0]["box"], F.transform("b", lambda x: x["box"]))
    return per.select("img", F.size("b").cast("long").alias("n"), each.alias("iou")).select("img", "n", F.round(F.array_max("iou"), 8).alias("best"), F.round(F.aggregate("iou", F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


_CAT = "case lang when 'en' then 'negative' when 'fr' then 'fire_only' when 'de' then 'smoke_only' else 'fire_smoke' end"


@query("name_functions", f"""select doc_id, case when {_CAT} in ('fire_only', 'smoke_only') then {_CAT} else 'stable' end as grp, case when doc_id % 3 = 0 then doc_id else 1000000000 end as epoch, case when doc_id % 4 = 0 then 0.0 else doc_id / 8.0 end as value, '/data/' || source || '/' || doc_id || '.jpg' as path, '/data/' || source as parent, case when doc_id % 2 = 0 then '025' else '050' end as tag from documents""")
def name_functions(spark, sf_dir):
    k, text = F.col("doc_id"), F.col("doc_id").cast("string")
    cat = F.when(F.col("lang") == "en", "negative").when(F.col("lang") == "fr", "fire_only").when(F.col("lang") == "de", "smoke_only").otherwise("fire_smoke")
    epoch = F.concat(F.lit("runs/epoch"), text, F.when(k % 3 == 0, ".pt").otherwise(".bin"))
    number = F.when(k % 4 == 0, F.concat(F.lit("x"), text)).otherwise((k / 8).cast("string"))
    raw = F.concat(F.when(k % 2 == 0, F.lit("./x/../")).otherwise(F.lit("/data//")), "source", F.when(k % 5 == 0, F.lit("\\")).otherwise(F.lit("/")), text, F.lit(".jpg"))
    d = docs(spark, sf_dir).withColumn("path", s.path_key(raw, "/data"))
    return d.select("doc_id", s.category_group(cat).alias("grp"), s.epoch_number(epoch).cast("long").alias("epoch"), s.safe_double(number).alias("value"), "path", s.parent_path("path").alias("parent"), s.threshold_tag(F.when(k % 2 == 0, 0.25).otherwise(0.5)).alias("tag"))


@query("class_profiles", "with c as (select source, lang, count(*) as n from documents group by 1, 2) select source, string_agg(lang || ':' || n, ';' order by lang) as profile from c group by 1")
def class_profiles(spark, sf_dir):
    c = docs(spark, sf_dir, "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m")).select("source", s.class_profile("m").alias("profile"))


@query("risk_reasons", f"""with x as (select doc_id, doc_id % 3 // 2 as missing_fire, doc_id % 5 // 4 as missing_smoke, doc_id % 4 // 3 as class_conflicts, doc_id % 7 as unsupported_gt, doc_id % 6 as strong_singletons, {_CAT} as cat from documents)
    select doc_id, coalesce(nullif(array_to_string(list_filter([case when missing_fire > 0 then 'missing_fire' end, case when missing_smoke > 0 then 'missing_smoke' end, case when class_conflicts > 0 then 'class_conflict' end, case when unsupported_gt > 0 then 'unsupported_gt' end, case when strong_singletons > 0 then 'strong_singleton' end], lambda x: x is not null), '|'), ''), 'risk_prior') as reason,
    round((missing_fire + missing_smoke) * 2.5 + unsupported_gt * 1.5 + class_conflicts * 2.5 + least(strong_singletons * 0.5, 2.0) + case when cat in ('fire_only', 'smoke_only') and missing_fire + missing_smoke > 0 then 0.75 else 0 end, 8) as risk, round(0.45 * (doc_id % 10) / 10 + 0.35 * (doc_id % 4) / 4 + 0.2 * (doc_id % 8) / 8, 8) as annotation from x""")  # fmt: skip
def risk_reasons(spark, sf_dir):
    k = F.col("doc_id")
    part = lambda n, m: F.floor(k % n / m)
    cat = F.when(F.col("lang") == "en", "negative").when(F.col("lang") == "fr", "fire_only").when(F.col("lang") == "de", "smoke_only").otherwise("fire_smoke")
    x = docs(spark, sf_dir, "doc_id", "lang").withColumns({"missing_fire": part(3, 2), "missing_smoke": part(5, 4), "class_conflicts": part(4, 3), "unsupported_gt": k % 7, "strong_singletons": k % 6, "cat": cat})
    risk = s.risk_score(F.col("missing_fire") + F.col("missing_smoke"), "unsupported_gt", "class_conflicts", "strong_singletons", "cat")
    return x.select("doc_id", s.reason().alias("reason"), F.round(risk, 8).alias("risk"), F.round(s.annotation_score(k % 10 / 10, k % 4 / 4, k % 8 / 8), 8).alias("annotation"))
