"""Marker checks on columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quillstream.functions import markers

_MARKER = StructType([StructField("kind", StringType()), StructField("idx", IntegerType())])
_SCANNED = StructType([StructField("ok", BooleanType()), StructField("error", StringType()), StructField("markers", ArrayType(_MARKER))])


@F.pandas_udf(ArrayType(StringType()))
def missing_markers(source: pd.Series, translated: pd.Series) -> pd.Series:
    """Names of the source's markers that the translation lacks; none where the source can't be scanned."""
    return pd.Series([markers.missing(s, t) if s and ("⟦" in s or "<" in s) else [] for s, t in zip(source, translated, strict=True)])


@F.pandas_udf(_SCANNED)
def scanned(text: pd.Series) -> pd.DataFrame:
    """Whether a text is in the marker language, else why not; and its markers in order."""
    rows = []
    for t in text:
        try:
            found = [{"kind": "placeholder" if x.kind == "placeholder" else x.text, "idx": x.index} for x in markers.scan(t or "") if x.kind in ("placeholder", "open")]
            rows.append((True, None, found))
        except markers.MarkerError as fault:
            rows.append((False, str(fault), []))
    return pd.DataFrame(rows, columns=["ok", "error", "markers"])


def heal_status(attempts: DataFrame, keys: list[str], source: str, text: str, order: list[str], repairs: int = 2) -> DataFrame:
    """keys, status, repairs of each chunk and language: the first of 1 + ``repairs`` attempts in order that keeps all markers.

    Only the first few attempts of a group are checked and gathered, however many there are.
    """
    lost = F.size(missing_markers(F.col(source), F.coalesce(F.col(text), F.lit(""))))
    # the rank limit applies inside each map task before the shuffle, so that a chunk asked for very often sends a few rows a task
    ranked = attempts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= repairs + 1)
    rows = ranked.select(*keys, "_rank", (F.col(text).isNotNull() & (lost == 0)).alias("fine"))
    first = F.array_sort(F.collect_list(F.struct("_rank", "fine")))
    flags = rows.groupBy(*keys).agg(F.transform(first, lambda x: x["fine"]).alias("fine"))
    place = F.array_position("fine", True)
    status = F.when(place == 1, "ok").when(place > 1, "repaired").otherwise("unrecoverable")
    return flags.select(*keys, status.alias("status"), F.when(place > 0, place - 1).otherwise(F.size("fine") - 1).cast("int").alias("repairs"))
