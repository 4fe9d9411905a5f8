"""Replies of a translator: parsing, checking their ids, choosing a repaired item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.model import REPLY


def items(frame: DataFrame, column: str) -> DataFrame:
    """One row an item of each JSON reply, with its place; replies that are no such object give none (see ``unparsable``)."""
    kept = [c for c in frame.columns if c != column]
    return frame.select(*kept, F.posexplode(F.from_json(column, REPLY).getField("translations")).alias("pos", "item")).select(*kept, "pos", F.col("item.chunkId").alias("chunk_id"), F.col("item.translatedText").alias("translated_text"))


def unparsable(column: str) -> Column:
    return F.from_json(F.col(column), REPLY).getField("translations").isNull()


def check_ids(requested: DataFrame, returned: DataFrame, batch: str) -> DataFrame:
    """batch, missing, unexpected, duplicated, message of each batch whose returned ids aren't exactly the requested ones.

    Ids meet by join and are counted first, so that only faulty ids are gathered; a batch is bounded by its token budget.
    """
    asked = requested.groupBy(batch, "chunk_id").agg(F.count("*").alias("asked"))
    got = returned.groupBy(batch, "chunk_id").agg(F.count("*").alias("got"))
    both = asked.join(got, [batch, "chunk_id"], "full")
    fault = F.when(F.col("got").isNull(), "missing").when(F.col("asked").isNull(), "unexpected")
    odd = both.select(batch, "chunk_id", F.filter(F.array(fault, F.when(F.col("got") > 1, "duplicated")), lambda x: x.isNotNull()).alias("faults"))
    rows = odd.where(F.size("faults") > 0).withColumn("fault", F.explode("faults"))

    def listed(name: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("fault") == name, F.col("chunk_id")))), ", ").alias(name)

    names = ("missing", "unexpected", "duplicated")
    found = rows.groupBy(batch).agg(*(listed(n) for n in names))
    parts = F.array(*(F.when(F.col(n) != "", F.concat(F.lit(f"{n}: "), n)) for n in names))
    message = F.concat(F.lit("Chunk id mismatch in provider response ("), F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; "), F.lit(")."))
    return found.withColumn("message", message)


def repaired_item(reply: Column, chunk_id: Column) -> Column:
    """Text of the item with the id, else of the first item."""
    found = F.from_json(reply, REPLY).getField("translations")
    own = F.get(F.filter(found, lambda x: x["chunkId"] == chunk_id), F.lit(0))
    return F.coalesce(own, F.get(found, F.lit(0))).getField("translatedText")
