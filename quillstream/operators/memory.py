"""Translation memory: the latest translation of each (path, target_lang, content_hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.skew import lookup_join

KEY = ["path", "target_lang", "content_hash"]


def upsert(old: DataFrame | None, new: DataFrame, order: str) -> DataFrame:
    """One row a key, the new rows winning over the old and later new ones over earlier; nothing is ever evicted.

    Both are aggregated in one pass with partial aggregation; rows without a full key or text hold nothing.
    """
    rows = new.select(*KEY, "translated_text", F.lit(1).alias("age"), F.col(order).alias("seq"))
    if old is not None:
        rows = rows.unionByName(old.select(*KEY, "translated_text", F.lit(0).alias("age"), F.lit(None).cast(dict(rows.dtypes)["seq"]).alias("seq")))
    full = rows.where(" and ".join(f"{k} is not null" for k in [*KEY, "translated_text"]))
    return full.groupBy(*KEY).agg(F.max(F.struct("age", "seq", "translated_text")).getField("translated_text").alias("translated_text"))


def probe(wanted: DataFrame, memory: DataFrame) -> DataFrame:
    """``wanted`` with the remembered text, or null. One join gives hits and misses alike; the memory has one row a key, so
    nothing fans out, and a key wanted very often is no hot task."""
    counts = wanted.groupBy(*KEY).agg(F.count("*").alias("_n"))
    return lookup_join(wanted, memory.join(counts, KEY).select(*KEY, "translated_text", "_n"), KEY, "_n", how="left")


def hits(wanted: DataFrame, memory: DataFrame) -> DataFrame:
    return wanted.join(memory, KEY, "left_semi")


def misses(wanted: DataFrame, memory: DataFrame) -> DataFrame:
    return wanted.join(memory, KEY, "left_anti")

