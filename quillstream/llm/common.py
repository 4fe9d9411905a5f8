"""Shared plumbing of the training-data operators: reading tables, checkpoints, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.sources.shared import ensure_checkpoint_dir

#: A Python worker handles this many characters at a time, whatever an Arrow batch holds.
SLICE_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage into the shared folder, so that a lost executor costs no more than its own tasks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sample_rows(df: DataFrame, key: str, bound: int, label: str | None = None) -> DataFrame:
    """At most ``bound`` rows, those with the lowest hashes of ``key``: the same rows on every run. For fitting only.

    With ``label`` (a language label) each of its languages gets a like number of rows, or all that it has: a rare one isn't lost.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key)))
    code = F.lower(F.regexp_extract(F.col(label), r"^\s*([A-Za-z]{2})(?:[-_][A-Za-z0-9]{2,8})*\s*$", 1)) if label else F.lit("")
    # there are no more than 26 * 26 codes
    counts = {r.code: r.n for r in df.select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect() if r.code or not label}
    quota = _quotas(counts, bound)
    below = F.lit(None).cast("double")
    for c, n in quota.items():
        # a little more than the quota comes through the filter; the rank on these few rows settles it
        below = F.when(code == c, min(1.0, (n + 8 * n**0.5 + 8) / counts[c])).otherwise(below)
    place = (F.col("_hash").cast("double") + 2.0**63) / 2.0**64
    some = hashed.withColumn("_code", code).where(place < below + 1e-12)
    rank = F.row_number().over(Window.partitionBy("_code").orderBy("_hash", F.col(key)))
    most = F.lit(0)
    for c, n in quota.items():
        most = F.when(F.col("_code") == c, n).otherwise(most)
    return some.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_hash", "_code", "_rank")


def _quotas(counts: dict[str, int], bound: int) -> dict[str, int]:
    """Of ``bound`` rows a like number for each, what the small ones leave over going to the others."""
    quota: dict[str, int] = {}
    left = bound
    for n, (code, have) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quota[code] = min(have, left // (len(counts) - n))
        left -= quota[code]
    return quota


def by_size(sizes: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cuts 0..len(sizes) into runs of about ``most`` in total; a larger single one stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
