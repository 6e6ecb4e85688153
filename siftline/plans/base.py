"""Registry of queries, and the views that many of them share, in Spark and in oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its oracle where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SPLIT = "case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'val' else 'test' end"
SQL_DOCS = f"docs as (select doc_id, text, lang, source, n_chars, {SPLIT} as split from documents)"


def docs(spark, sf_dir, *columns: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("split", F.expr(SPLIT))
    return d.select(*columns) if columns else d


SQL_BOX = """box as (select *, xc-w/2 as x1, yc-h/2 as y1, xc+w/2 as x2, yc+h/2 as y2, w*h as share from (
    select l_orderkey * 100000 + row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) - 1 as bid, l_orderkey as img, cast(l_suppkey%2 as int) as cls, l_quantity/50.0 as xc,
    abs(l_discount)*10.0 as yc, abs(l_tax)*10.0 as w, (l_partkey%100)/100.0 as h, l_linestatus as side, (l_extendedprice%1000)/1000.0 as conf, cast(l_suppkey%3 as int) as model from lineitem))"""

_BOX_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def boxes(spark, sf_dir, numbered: bool = True) -> DataFrame:
    """Boxes made of order lines; the number bid is the image's and the place within it, so it needs no global order."""
    x = read(spark, sf_dir, "lineitem")
    if numbered:
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_BOX_ORDER))
        x = x.withColumn("bid", F.col("l_orderkey") * 100_000 + place - 1)
    b = x.select(
        *(["bid"] if numbered else []), F.col("l_orderkey").alias("img"), (F.col("l_suppkey") % 2).cast("int").alias("cls"), (F.col("l_quantity") / 50).alias("xc"), (F.abs("l_discount") * 10).alias("yc"), (F.abs("l_tax") * 10).alias("w"),
        ((F.col("l_partkey") % 100) / 100).alias("h"), F.col("l_linestatus").alias("side"), ((F.col("l_extendedprice") % 1000) / 1000).alias("conf"), (F.col("l_suppkey") % 3).cast("int").alias("model"),
    )
    return b.withColumns({"box": g.corners("xc", "yc", "w", "h"), "share": F.col("w") * F.col("h")})


SQL_IOU = """greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1))"""
SQL_AREA = "greatest(0,{0}.x2-{0}.x1)*greatest(0,{0}.y2-{0}.y1)"


def sql_iou(a: str = "a", b: str = "b") -> str:
    both = f"(greatest(0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1)) * greatest(0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    union = f"({SQL_AREA.format(a)} + {SQL_AREA.format(b)} - {both})"
    return f"(case when {union} <= 0 then 0.0 else {both}/{union} end)"


SQL_ANN = "ann as (select doc_id, case when doc_id % 11 <> 0 then [{'cls': cast((doc_id//2)%2 as int), 'xc': (doc_id%3)/10.0}] || case when doc_id % 2 = 1 then [{'cls': cast((doc_id//2)%2 as int), 'xc': (doc_id%3)/10.0}] else [] end end as boxes from documents)"


def annotations(d: DataFrame) -> DataFrame:
    """A synthetic box array per document: null plays a missing label."""
    one = F.expr("named_struct('cls', cast((doc_id div 2) % 2 as int), 'xc', cast(doc_id % 3 as double) / 10, 'yc', 0d, 'w', 0d, 'h', 0d)")
    return d.withColumn("boxes", F.when(F.col("doc_id") % 11 != 0, F.array_repeat(one, (1 + F.col("doc_id") % 2).cast("int"))))


SQL_DUP = """dup as (select a.doc_id as id_a, b.doc_id as id_b, a.split as split_a, b.split as split_b from docs a join docs b on a.text = b.text and a.doc_id < b.doc_id)"""


def relation_sql(a: str, b: str) -> str:
    rank = lambda s: f"(case {s} when 'train' then 0 when 'val' then 1 else 2 end)"
    return f"(case when {a}={b} then 'same_'||{a} when {rank(a)}<={rank(b)} then {a}||'_'||{b} else {b}||'_'||{a} end)"


def dup_pairs(spark, sf_dir, *columns: str) -> DataFrame:
    """Pairs of documents with equal text, by its hash."""
    from ..operators.dedup import member_pairs

    d = docs(spark, sf_dir).withColumn("sha", F.sha2("text", 256)).select("sha", "doc_id", "split", *columns)
    return member_pairs(d, "sha", "doc_id", ["split", *columns])
