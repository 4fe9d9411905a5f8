"""Greedy batching of each document's chunks under a token budget, in order.

A batch closes when it isn't empty and the next chunk would take it over the budget; a chunk over the budget is alone.
That is a chain: where a batch begins fixes where it ends. Only keys and token counts are numbered; the rows' other columns are
joined back. Documents are dealt out by hash and sorted, and each task follows its chains in a stream, a row at a time
in effect, so that it holds no more than an Arrow batch.

A document of more than ``HOT_ROWS`` chunks spans many tasks. Each works out, for each number of tokens that an open batch may
bring along, how many batches begin in its part and what is open at its end; these short tables are linked by a
task a document, and then every part knows what it is entered with, and numbers its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillstream.functions.skew import HOT_ROWS
from quillstream.sources.shared import ensure_checkpoint_dir

BUDGET = 4000


def chain(sums: np.ndarray, begin: int, budget: int) -> list[int]:
    """Starts of the batches from row ``begin`` on; ``sums`` has the tokens before each row and, last, those of all."""
    starts, at = [], begin
    while at < len(sums) - 1:
        starts.append(at)
        at = max(at + 1, int(np.searchsorted(sums, sums[at] + budget, side="right")) - 1)
    return starts


def entered(sums: np.ndarray, carried: int, budget: int) -> tuple[list[int], int]:
    """Starts of the batches if ``carried`` tokens are open before the rows (-1: no batch is), and the tokens open behind them."""
    begin = 0 if carried < 0 else max(0, int(np.searchsorted(sums, budget - carried, side="right")) - 1)
    starts = chain(sums, begin, budget)
    return starts, int(sums[-1] - sums[starts[-1]]) if starts else max(carried, 0) + int(sums[-1])


def _entries(sums: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """(least tokens brought along, batches begun, tokens open) wherever the first start changes; -1 stands for no open batch.

    Where none begins, the open tokens are the rows' own only.
    """
    starts, left = entered(sums, -1, budget)
    found = [(-1, len(starts), left), (0, 0, int(sums[-1]))]
    # with b tokens open, the first start is the first row k with b + sums[k + 1] > budget
    for k in range(len(sums) - 1):
        least = max(0, budget - int(sums[k + 1]) + 1)
        starts = chain(sums, k, budget)
        found = [f for f in found if f[0] != least] + [(least, len(starts), int(sums[-1] - sums[starts[-1]]))]
        if least == 0:
            break
    return found


def _sums(tokens: pd.Series) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(tokens.to_numpy(np.int64))])


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (a.eqNullSafe(b) for a, b in zip(left, right, strict=True)))


def _numbered(places: DataFrame, group: list[str], order: list[str], budget: int) -> DataFrame:
    schema = StructType([*(places.schema[c] for c in [*group, *order]), StructField("batch_no", IntegerType())])

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # key of the last row
        carried, done = -1, 0
        for pdf in parts:
            if not len(pdf):
                continue
            changed = np.zeros(len(pdf), bool)
            for c in group:
                value, null = pdf[c].to_numpy(object), pdf[c].isna().to_numpy()
                changed[1:] |= (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (value[1:] != value[:-1]))
            key = tuple(None if pd.isna(x) else x for x in pdf[group].iloc[0])
            if key != last:
                carried, done = -1, 0
            edges = [0, *np.flatnonzero(changed).tolist(), len(pdf)]
            numbers = np.zeros(len(pdf), np.int32)
            for n, (a, b) in enumerate(zip(edges, edges[1:])):
                if n:
                    carried, done = -1, 0
                starts, left = entered(_sums(pdf["_tokens"].iloc[a:b]), carried, budget)
                marks = np.zeros(b - a, np.int32)
                marks[starts] = 1
                numbers[a:b] = done - 1 + np.cumsum(marks)
                carried, done = left, done + len(starts)
            last = tuple(None if pd.isna(x) else x for x in pdf[group].iloc[-1])
            yield pdf[[*group, *order]].assign(batch_no=numbers)

    return places.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(number, schema)


def _giants(places: DataFrame, group: list[str], order: list[str], budget: int, parts: int) -> DataFrame:
    sorted_ = places.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    # range borders are sampled; the checkpoint keeps them, and the rows' order, for every later step
    rows = sorted_.select(*group, *order, "_tokens", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).checkpoint()
    keys = [*(rows.schema[c] for c in group), StructField("_part", IntegerType())]

    def survey(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _entries(_sums(pdf.sort_values("_at")["_tokens"]), budget)
        head = pdf[[*group, "_part"]].iloc[:1]
        return pd.concat([head] * len(found), ignore_index=True).assign(least=[f[0] for f in found], begun=[f[1] for f in found], open=[f[2] for f in found])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        carried, done, found = -1, 0, []
        for part, own in pdf.sort_values(["_part", "least"]).groupby("_part", sort=True):
            found.append((part, carried, done))
            fits = own[own["least"] == -1] if carried < 0 else own[(own["least"] >= 0) & (own["least"] <= carried)]
            begun, left = int(fits["begun"].iloc[-1]), int(fits["open"].iloc[-1])
            carried, done = left + (max(carried, 0) if not begun else 0), done + begun
        head = pdf[group].iloc[:1]
        return pd.concat([head] * len(found), ignore_index=True).assign(_part=[f[0] for f in found], carried=[f[1] for f in found], done=[f[2] for f in found])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        marks = np.zeros(len(pdf), np.int32)
        marks[entered(_sums(pdf["_tokens"]), int(pdf["carried"].iloc[0]), budget)[0]] = 1
        return pdf[[*group, *order]].assign(batch_no=(int(pdf["done"].iloc[0]) - 1 + np.cumsum(marks)).astype(np.int32))

    longs = lambda *names: StructType([*keys, *(StructField(n, LongType()) for n in names)])
    entries = rows.groupBy(*group, "_part").applyInPandas(survey, longs("least", "begun", "open"))
    linked = entries.groupBy(*group).applyInPandas(link, longs("carried", "done"))
    own = linked.select(*(F.col(c).alias(f"_g{n}") for n, c in enumerate(group)), F.col("_part").alias("_p"), "carried", "done")
    known = rows.join(own, _same([F.col(c) for c in [*group, "_part"]], [F.col(c) for c in [*(f"_g{n}" for n in range(len(group))), "_p"]]))
    schema = StructType([*(places.schema[c] for c in [*group, *order]), StructField("batch_no", IntegerType())])
    return known.select(*group, *order, "_tokens", "_part", "_at", "carried", "done").groupBy(*group, "_part").applyInPandas(number, schema)


def batches(frame: DataFrame, group: list[str], order: list[str], tokens: str, budget: int = BUDGET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``frame`` with batch_no (from 0) in each group.

    Null and non-positive counts are taken as 1. Rows that are equal in group and order can't be told apart in order: they go into
    the same batch, as one of their sum. A null group is a group, a null place comes first.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    count = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(1)), F.lit(1))
    places = frame.groupBy(*group, *order).agg(F.sum(count).alias("_tokens")).checkpoint()
    sizes = places.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*(F.col(c).alias(f"_g{n}") for n, c in enumerate(group)), "_n").checkpoint()
    hot = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if hot:
        # there are no more hot documents than rows / hot_rows
        of_hot = _same([F.col(c) for c in group], [F.col(f"_g{n}") for n in range(len(group))])
        cold = places.join(F.broadcast(sizes), of_hot, "left_anti")
        numbered = _numbered(cold, group, order, budget).unionByName(_giants(places.join(F.broadcast(sizes), of_hot, "left_semi"), group, order, budget, 2 + 2 * hot // hot_rows))
    else:
        numbered = _numbered(places, group, order, budget)
    kept = [c for c in frame.columns if c != "batch_no"]
    named = numbered.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate([*group, *order])), "batch_no")
    rows = frame.select(*kept)
    return rows.join(named, _same([F.col(c) for c in [*group, *order]], [F.col(f"_k{n}") for n in range(len(group) + len(order))])).select(*kept, "batch_no")
