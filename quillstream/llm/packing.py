"""Problem 5: texts into containers of a fixed token capacity by cost-balanced packing.

A text of n tokens costs LINEAR * n + QUADRATIC * n^2 (attention is quadratic inside a text, all else linear). Texts go in
descending order to the sequence of lowest cost that still has room, so that sequences end up about as dear as each other
and about full; one opens only where none has room. A text over the capacity is cut into full pieces, each a container
of its own, and a rest that is packed like a text.

Texts are dealt to shards by hash, as many as the tokens and rows of all texts need for a shard to stay bounded; each is
packed by one task from identifiers and sizes alone. The loss is the last few open containers of a shard.

Defined results: null texts have no container, empty ones take no room in one; ties go to the smaller id, then the older
sequence; rows with the same id are packed one by one; extra columns aren't read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import tokens
from quillstream.llm.common import checkpoint

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SHARD_CONTAINERS, SHARD_ROWS = 2048, 200_000


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Sequences:
    """Open sequences by room left; a tree over the rooms gives the cheapest with room for n."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree: list[tuple[float, int]] = [(float("inf"), -1)] * (2 * self.leaves)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.count = capacity, 0

    def _update(self, room: int) -> None:
        heap, tree = self.heaps[room], self.tree
        at = self.leaves + room
        tree[at] = heap[0] if heap else (float("inf"), -1)
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            best = left if left <= right else right
            if tree[at] == best:
                break
            tree[at] = best

    def open(self, n: int) -> None:
        for _ in range(n):
            heapq.heappush(self.heaps[self.capacity], (0.0, self.count))
            self.count += 1
        self._update(self.capacity)

    def _cheapest(self, n: int) -> int:
        """Room of the cheapest sequence with room for n, or -1."""
        lo, hi = self.leaves + n, self.leaves + self.capacity + 1
        best, where = (float("inf"), -1), -1
        while lo < hi:
            for side in ([lo] if lo & 1 else []) + ([hi - 1] if hi & 1 else []):
                if self.tree[side] < best:
                    best, where = self.tree[side], side
            lo, hi = (lo + 1) >> 1, hi >> 1
        if where < 0 or best[1] < 0:
            return -1
        while where < self.leaves:
            where = 2 * where if self.tree[2 * where] == self.tree[where] else 2 * where + 1
        return where - self.leaves

    def put(self, n: int) -> int:
        room = self._cheapest(n)
        if room < 0:
            self.open(1)
            room = self.capacity
        spent, sequence = heapq.heappop(self.heaps[room])
        self._update(room)
        heapq.heappush(self.heaps[room - n], (spent + cost(n), sequence))
        self._update(room - n)
        return sequence


def assign(items: list[int], capacity: int) -> list[int]:
    """Sequence of each item, the items in descending order."""
    sequences = Sequences(capacity)
    sequences.open(-(-sum(items) // capacity))
    return [sequences.put(n) for n in items]


def pack(frame: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, piece_no, pieces, first_token, tokens, container_id: a row a text, or a piece of one over the capacity."""
    sized = checkpoint(tokens.sizes(frame, key, text, path))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    cut = sized.select("key", "tokens", pieces.alias("pieces")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    first = F.col("piece_no").cast("long") * capacity
    items = cut.select(F.col("key").alias("doc_id"), "piece_no", "pieces", first.alias("first_token"), F.least(F.col("tokens") - first, F.lit(capacity)).alias("tokens"))
    full = items.where(F.col("tokens") == capacity).withColumn("container_id", F.format_string("full-%d-%d", "doc_id", "piece_no"))
    rest = items.where(F.col("tokens") < capacity)
    total, rows = rest.agg(F.sum("tokens"), F.count("*")).first()
    shards = max(1, -(-(total or 0) // (capacity * SHARD_CONTAINERS)), -(-rows // SHARD_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        found = assign(pdf["tokens"].tolist(), capacity)
        shard = int(pdf["shard"].iloc[0])
        return pdf.drop(columns="shard").assign(container_id=[f"{shard}-{n}" for n in found])

    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece_no int, pieces int, first_token long, tokens long, container_id string")
    return packed.unionByName(full.select(packed.columns))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, texts, tokens, fill, cost of every container."""
    n = F.col("tokens").cast("double")
    spent = F.sum(F.lit(LINEAR) * n + F.lit(QUADRATIC) * n * n)
    return packed.groupBy("container_id").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / capacity).alias("fill"), F.round(spent, 3).alias("cost"))
