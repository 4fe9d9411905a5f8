"""Tables and files in any storage that the cluster reads: versions that appear whole or not at all, files written by tasks.

A versioned table is a folder of folders ``v-0000000007``. The one with the highest number that holds Spark's ``_SUCCESS`` mark
counts; the mark comes last, so that a reader sees the old version or the new one, in stores without renames too. A write
goes to a new number, so that a run that dies leaves nothing that counts, and of two writers at a time one fails.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_VERSION = re.compile(r"v-(\d{10})")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path or URI, and the path there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> dict[int, bool]:
    """Numbers of the versions and whether each is whole. A folder with anything else in it is no such table, which is an error."""
    system, where = file_system(spark, root)
    if not system.exists(where):
        return {}
    found = {}
    for status in system.listStatus(where):
        name = status.getPath().getName()
        m = _VERSION.fullmatch(name)
        if m:
            found[int(m[1])] = system.exists(file_system(spark, f"{root}/{name}/_SUCCESS")[1])
        elif not name.startswith((".", "_")):
            raise ValueError(f"'{root}' holds '{name}' and is no versioned table")
    return found


def read_version(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The last whole version; empty before the first. Versions of which none is whole are an error, not an empty table."""
    known = versions(spark, root)
    whole = [n for n, ok in known.items() if ok]
    if known and not whole:
        raise ValueError(f"no version in '{root}' is whole")
    if not whole:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/v-{max(whole):010}")
    return rows.select(*(f"`{n}`" for n in StructType.fromDDL(schema).names))  # columns that name folders come last else


def write_version(frame: DataFrame, root: str, partition_by: list[str] | None = None, keep: int = 2) -> int:
    """Writes a new version and gives its number; of older ones the last ``keep`` stay for those who are reading them."""
    spark = frame.sparkSession
    known = versions(spark, root)
    number = max(known, default=0) + 1
    frame.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(f"{root}/v-{number:010}")
    whole = sorted(n for n, ok in known.items() if ok)
    for old in {*whole[: max(0, len(whole) - keep)], *(n for n, ok in known.items() if not ok)}:
        system, where = file_system(spark, f"{root}/v-{old:010}")
        system.delete(where, True)
    return number


def inside(name: str) -> str:
    """A path below a root, in one spelling; one that leaves the root is an error."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"output path leaves its root: {name}")
    return "/".join(parts)


def write_files(frame: DataFrame, root: str, path: str, text: str) -> int:
    """Each row as a file below ``root``, a URI or a folder that all workers share; the number written.

    A task writes beside the file and moves it into place, so that one that runs twice leaves the same and no half file.
    """
    base = root if "://" in root else os.path.abspath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder, _, file = f"{top.rstrip('/')}/{inside(name)}".rpartition("/")
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{file}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as stream:
                    stream.write(body.as_py().encode())
                system.move(part, f"{folder}/{file}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    named = frame.select(path, text).where(F.col(path).isNotNull() & F.col(text).isNotNull())
    return named.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
