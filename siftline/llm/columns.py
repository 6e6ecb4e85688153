"""Room for result columns beside whatever columns a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def make_room(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with every column that clashes with a result's name given underscores at its end."""
    taken = {c.lower() for c in docs.columns} | {n.lower() for n in names}
    out = docs
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            out = out.withColumnRenamed(c, new)
    return out


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
