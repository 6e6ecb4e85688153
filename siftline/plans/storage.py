"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again.
The tables go below ``spark.checkpoint.dir``; a lost executor then costs a task,
never an iteration.  Parquet is used rather than ``checkpoint()``: it is smaller
and the readers that follow keep column pruning.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_FOLDER = f"siftline-{uuid.uuid4().hex[:12]}"
_own: dict[str, str] = {}
_cleared: set[str] = set()
#: Tables written inside each open ``scratch`` block, innermost last.
_open: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode without one, a folder of our own."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="siftline-")
        atexit.register(shutil.rmtree, path, True)
        _own[app] = f"file://{path}"
    return _own[app]


def new_path(spark: SparkSession, name: str = "table") -> str:
    folder = f"{shared_folder(spark)}/{_FOLDER}"
    if folder not in _cleared:
        _cleared.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _clear(spark: SparkSession, folder: str) -> None:
    """At the driver's end, when no DataFrame can read the tables any more."""
    with suppress(Exception):  # the session may have ended before
        remove(spark, folder)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    if _open:
        _open[-1].append(back)
    return back


@contextmanager
def scratch():
    """Drop the tables stored inside the block when it ends, but for those handed to ``keep``.

    Use it where everything a result reads is stored and kept: what was dropped
    can't be read again.
    """
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append([])
    try:
        yield keep
    finally:
        made = _open.pop()
        ids = {id(k) for k in kept}
        for df in made:
            if id(df) not in ids:
                drop_stored(df)
            elif _open:
                _open[-1].append(df)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored``; nothing may read it afterwards."""
    path = getattr(df, "_stored_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
