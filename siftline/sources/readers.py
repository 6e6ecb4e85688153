"""Scans: files, text labels, manifests, CSV, JSON, archives, images.

All are lazy DataFrames; a scan that only needs names and sizes never reads
contents (column pruning on ``binaryFile``).
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import path_extension, path_stem
from . import schemas

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
#: Of these the built-in image source decodes all but the last.
DECODED_EXTENSIONS = IMAGE_EXTENSIONS[:-1]


def _paths(path) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def files(spark: SparkSession, path, extensions=None, recursive: bool = False, content: bool = False) -> DataFrame:
    """``path, stem, ext, length`` (and ``content``) of the files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(_paths(path))
    df = df.select("path", path_stem("path").alias("stem"), path_extension("path").alias("ext"), "length", *(["content"] if content else []))
    return df.where(F.col("ext").isin(*extensions)) if extensions else df


def images(spark: SparkSession, path, recursive: bool = False, content: bool = False) -> DataFrame:
    return files(spark, path, IMAGE_EXTENSIONS, recursive, content)


def stem_index(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index ``stem, path`` and the stems that have several paths."""
    double = found.groupBy("stem").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths")).where("n > 1")
    return found.select("stem", "path"), double


def resolve_stems(stems: DataFrame, found: DataFrame, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """Per stem the path whose extension comes first, and whether its files differ in content."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    f = found.where(rank > 0).groupBy("stem").agg(F.min_by("path", F.struct(rank, "path")).alias("path"), F.count_distinct(F.sha2("content", 256)).alias("contents"))
    return stems.join(f, "stem", "left").select("stem", "path", (F.coalesce("contents", F.lit(0)) > 1).alias("conflict"))


def label_texts(spark: SparkSession, path) -> DataFrame:
    """``stem, text``: label files, each as one text; an empty file is an empty text."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(_paths(path))
    return df.select(path_stem("path").alias("stem"), F.decode("content", "UTF-8").alias("text"))


def split_list(spark: SparkSession, path, split: str) -> DataFrame:
    """``split, entry, stem`` of a text list of paths or stems; blank lines go, repeats stay."""
    df = spark.read.text(_paths(path)).select(F.trim("value").alias("entry")).where("entry <> ''")
    return df.select(F.lit(split).alias("split"), "entry", path_stem("entry").alias("stem"))


def manifest(spark: SparkSession, path, comments: bool = False) -> DataFrame:
    """``stem``: a manifest as a set; lines that begin with # are skipped where ``comments``."""
    df = spark.read.text(_paths(path)).select(F.trim("value").alias("entry")).where("entry <> ''")
    if comments:
        df = df.where(~F.col("entry").startswith("#"))
    return df.select(path_stem("entry").alias("stem")).distinct()


def manifest_repeats(spark: SparkSession, path) -> DataFrame:
    """``stem, n`` of the stems a manifest names more than once."""
    return split_list(spark, path, "").where(~F.col("entry").startswith("#")).groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


def csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """A CSV file with a header and a declared schema; filters and columns reach the scan."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(_paths(path))


def hashes(spark: SparkSession, path) -> DataFrame:
    """Perceptual hashes with both hashes also as 64-bit integers."""
    from ..functions.scoring import hash_bits

    return csv(spark, path, schemas.HASHES).withColumns({"p": hash_bits("phash"), "d": hash_bits("dhash")})


def detections(spark: SparkSession, path, model: str) -> DataFrame:
    """``model, image, class_id, confidence, xyxy`` of a JSON-lines prediction cache; blank lines are skipped."""
    df = spark.read.schema(schemas.DETECTIONS).json(_paths(path)).where("image is not null")
    flat = df.select("image", F.explode("predictions").alias("p"))
    return flat.select(F.lit(model).alias("model"), "image", "p.class_id", "p.confidence", "p.xyxy")


def json_document(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(_paths(path))


def zip_members(spark: SparkSession, path, suffixes=None, most_bytes: int | None = None, contents: bool = False) -> DataFrame:
    """``archive, member, size`` (and ``text``) of the members of ZIP archives, read in the tasks that hold them."""
    archives = spark.read.format("binaryFile").load(_paths(path)).select("path", "content")

    def run(frames):
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                out = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        wanted = not m.is_dir() and (not suffixes or m.filename.lower().endswith(tuple(suffixes))) and (most_bytes is None or m.file_size <= most_bytes)
                        if wanted:
                            text = z.read(m).decode("utf-8", "replace") if contents else None
                            out.append((archive, m.filename, m.file_size, text))
                yield pd.DataFrame(out, columns=["archive", "member", "size", "text"])

    df = archives.mapInPandas(run, "archive string, member string, size long, text string")
    return df if contents else df.drop("text")


def voc_classes(text) -> "F.Column":
    """Object names of a Pascal VOC document; null where it isn't XML."""
    return F.when(F.col(text).rlike(r"(?s)^\s*<.*>\s*$"), F.xpath(F.col(text), F.lit("//object/name/text()")))


COCO = "images array<struct<id:long>>, annotations array<struct<id:long,category_id:long>>, categories array<struct<id:long,name:string>>"


def coco_summary(documents: DataFrame, text: str = "text") -> DataFrame:
    """Numbers of images and annotations, and the categories, of COCO documents."""
    parsed = documents.withColumn("_c", F.from_json(text, COCO))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return parsed.select(*documents.columns, count("_c.images").alias("n_images"), count("_c.annotations").alias("n_annotations"), F.transform(F.array_sort("_c.categories"), lambda c: c["name"]).alias("categories"))


def class_contract(text: str) -> list[str]:
    """Class names of a data YAML: a ``names`` list or mapping, in the order of the numbers."""
    lines, names, inside = text.splitlines(), {}, False
    for line in lines:
        bare = line.split("#")[0].rstrip()
        if bare.startswith("names:"):
            rest = bare[6:].strip()
            if rest.startswith("["):
                return [x.strip().strip("'\"") for x in rest.strip("[]").split(",") if x.strip()]
            inside = True
        elif inside and bare[:1] in (" ", "-"):
            item = bare.strip()
            if item.startswith("-"):
                names[len(names)] = item[1:].strip().strip("'\"")
            elif ":" in item:
                k, v = item.split(":", 1)
                names[int(k)] = v.strip().strip("'\"")
        elif bare:
            inside = False
    return [names[k] for k in sorted(names)]


def decoded_images(spark: SparkSession, path) -> DataFrame:
    """``path, stem, width, height, channels, pixels``: images in BGR order; pixels are null where a file can't be decoded."""
    df = spark.read.format("image").load(_paths(path))
    bad = F.col("image.nChannels") <= 0
    keep = lambda c: F.when(~bad, F.col(c))
    return df.select(F.col("image.origin").alias("path"), path_stem("image.origin").alias("stem"), keep("image.width").alias("width"), keep("image.height").alias("height"), keep("image.nChannels").alias("channels"), keep("image.data").alias("pixels"))


def valid_images(spark: SparkSession, path) -> DataFrame:
    """``path`` of the images that can be decoded."""
    return spark.read.format("image").option("dropInvalid", True).load(_paths(path)).select(F.col("image.origin").alias("path"))
