"""Writers.  Spark's commit protocol makes each of them atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, digits: dict[str, int] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header: the given columns only, floats with a fixed number of digits where asked."""
    out = df.select(*(columns or df.columns))
    for c, n in (digits or {}).items():
        out = out.withColumn(c, F.format_string(f"%.{n}f", F.col(c)))
    out.write.mode(mode).option("header", True).csv(path)


def union_of_columns(frames: list[DataFrame], first: str | None = None) -> DataFrame:
    """Rows of all frames over the union of their columns, ``first`` leading."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    names = sorted(out.columns, key=lambda c: c != first) if first else out.columns
    return out.select(*names)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row table as one JSON document; a report is small by nature."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_manifest(df: DataFrame, path: str, column: str = "stem", mode: str = "overwrite") -> None:
    """Distinct values, one a line, sorted across the files of the folder."""
    values = df.select(F.col(column).cast("string").alias("value")).distinct()
    values.orderBy("value").write.mode(mode).text(path)


def write_by(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One folder for each value of a column, such as a severity."""
    df.write.mode(mode).partitionBy(column).option("header", True).csv(path)


def label_files(boxes: DataFrame, stems: DataFrame) -> DataFrame:
    """``stem, text``: label texts rewritten from boxes in line order; stems without boxes get an empty text."""
    line = F.format_string("%d %.10f %.10f %.10f %.10f", "cls", "xc", "yc", "w", "h")
    texts = boxes.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))).alias("lines"))
    joined = stems.join(texts, "stem", "left")
    return joined.select("stem", F.coalesce(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


def copy_plan(selected: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """``stem, source, target``: what a copy or link of a data set has to do; files are moved outside the engine."""
    ext = F.regexp_extract("path", r"(\.[^./\\]*)$", 1)
    return selected.join(index, "stem").select("stem", F.col("path").alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), "split", F.lit("/"), "stem", ext).alias("target"))


def data_yaml(folder: str, names: list[str], splits=("train", "val", "test")) -> str:
    head = [f"path: {folder}", *(f"{s}: images/{s}" for s in splits), f"nc: {len(names)}", "names:"]
    return "\n".join(head + [f"  {i}: {n}" for i, n in enumerate(names)]) + "\n"


def summary_lines(df: DataFrame, name: str, value: str) -> DataFrame:
    """Name and value pairs as aligned text lines."""
    return df.select(F.concat(F.rpad(F.col(name).cast("string"), 40, "."), F.lit(" "), F.col(value).cast("string")).alias("line"))


def write_lock(spark: SparkSession, path: str, record: DataFrame) -> None:
    """A record that may exist once: fails if it does."""
    record.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("errorifexists").text(path)
