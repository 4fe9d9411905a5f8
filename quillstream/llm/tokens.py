"""Counting tokens of a public byte-level BPE vocabulary, whose file's place is a parameter.

The vocabulary's splitting pattern cuts a text into pretokens that are encoded one by one, and no match looks back. So
counts of parts add up exactly wherever a text is cut between pretokens; lines, which repeat, are counted once a worker.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The splitting pattern of this family of vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counted lines that a worker remembers.
REMEMBERED = 150_000
#: A longer line isn't worth remembering.
LONG_LINE = 600

LINES = re.compile(r"(?<=\S)(?=[ \t\r]*\n)")


class TokenCounter:
    def __init__(self, path: str = VOCABULARY) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of a short text that may come again."""
        n = self.known.get(text)
        if n is None:
            n = len(self.encoding.encode_ordinary(text))
            if len(text) <= LONG_LINE:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.unit, lines(text))) if text else 0


def lines(text: str) -> list[str]:
    """Cut before each line break, with the white space before it: always between pretokens."""
    return LINES.split(text)


_counters: dict[str, TokenCounter] = {}


def counter(path: str = VOCABULARY) -> TokenCounter:
    """One a Python worker, kept for its later tasks."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def sizes(frame: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, tokens of every row whose text isn't null; an empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["key", "tokens"])

    return frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null").mapInArrow(run, "key long, tokens long")
