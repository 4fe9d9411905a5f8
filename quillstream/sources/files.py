"""Reading and writing outside of tables: document trees, ignore and glossary files, memory, outputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import glob_regex, sha256_hex
from quillstream.model import MEMORY
from quillstream.operators.memory import upsert
from quillstream.sources.storage import file_system, read_version, write_files, write_version


def documents(spark: SparkSession, root: str, include: str = "**/*.md") -> DataFrame:
    """path (relative to root), body (UTF-8, no byte order mark), source_hash (of the raw bytes) of all files that match."""
    base = file_system(spark, root if "://" in root else os.path.abspath(root))[1].toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.expr(f"substring(path, instr(path, {_literal(base)}) + {len(base)})")
    rows = files.select(relative.alias("path"), "content").where(F.col("path").rlike(glob_regex(include)))
    return rows.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("body"), sha256_hex(F.col("content")).alias("source_hash"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ignore_patterns(path: str) -> list[str]:
    """Lines without blanks and comments; a missing file has none."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8-sig") as file:
        return [x for line in file if (x := line.strip()) and not x.startswith("#")]


def glossary_frame(spark: SparkSession, path: str) -> DataFrame:
    """One row with the glossary's JSON; a missing file is an empty glossary."""
    text = "{}"
    if os.path.exists(path):
        with open(path, encoding="utf-8-sig") as file:
            text = file.read()
    return spark.createDataFrame([(text,)], "json string")


def read_memory(spark: SparkSession, root: str) -> DataFrame:
    """The translation memory; before its first write it is empty."""
    return read_version(spark, root, MEMORY)


def write_memory(memory: DataFrame, root: str, new: DataFrame, order: str) -> int:
    """Old and new as the next version, a folder a language; its number."""
    return write_version(upsert(memory, new, order), root, ["target_lang"])


def write_outputs(outputs: DataFrame, root: str, path: str = "path", text: str = "markdown") -> int:
    """Each output as a file below root; the number written. The last of equal paths must have been chosen before."""
    return write_files(outputs, root, path, text)
