"""Joins that stand a key that holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is hot. At most (all rows / HOT_ROWS) keys can be, which bounds what is broadcast.
HOT_ROWS = 200_000


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row a key and in ``weight`` the number of left rows of that key.

    Rows of hot keys never meet in one task: the hot part of ``right`` has at most rows-of-left / hot_rows rows and is
    broadcast; all other rows are joined by shuffle. Null keys match nothing; ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    values = [c for c in right.columns if c not in keys and c != weight]
    hot = right.where(F.col(weight) > hot_rows).select(*keys, *values).withColumn("_hot", F.lit(True))
    cold = right.where(F.col(weight) <= hot_rows).select(*keys, *values)
    marked = left.join(F.broadcast(hot), keys, "left")
    first = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", *values).join(cold, keys, how)
    return first.unionByName(rest.select(first.columns))
