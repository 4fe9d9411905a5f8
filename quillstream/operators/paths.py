"""Where outputs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import slashes


def languages(text: str) -> list[str]:
    """Target languages of a comma-separated option; each once, as a repeated one would be an error later."""
    found = [x.strip() for x in text.split(",") if x.strip()]
    if len(set(found)) != len(found):
        raise ValueError("a target language is given twice")
    return found


def source_relative(path: Column, source_path: str) -> Column:
    """Without the leading folder of the sources, whatever its case."""
    normal = F.regexp_replace(slashes(path), "^/+", "")
    folder = source_path.replace("\\", "/").strip("/")
    if folder in ("", "."):
        return normal
    prefix = folder + "/"
    return F.when(F.lower(F.substring(normal, 1, len(prefix))) == prefix.lower(), F.substring(normal, len(prefix) + 1, 1 << 30)).otherwise(normal)


def output_path(template: Column | str, lang: Column, path: Column) -> Column:
    """A template's {lang}, {relativePath}, {dir}, {filename} and {ext}, put in one after another; empty segments fall away."""
    template = F.lit(template) if isinstance(template, str) else template
    normal = slashes(path)
    name = F.substring_index(normal, "/", -1)
    folder = F.when(F.contains(normal, F.lit("/")), F.regexp_replace(normal, "/[^/]*$", "")).otherwise("")
    dotted = name.rlike(r"(?s)^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    ext = F.when(dotted, F.substring_index(name, ".", -1)).otherwise("")
    out = template
    for mark, value in (("{lang}", lang), ("{relativePath}", normal), ("{dir}", folder), ("{filename}", stem), ("{ext}", ext)):
        out = F.replace(out, F.lit(mark), value)
    return F.array_join(F.filter(F.split(out, "/"), lambda s: s != ""), "/")


def per_language(frame: DataFrame, langs: list[str], name: str = "target_lang") -> DataFrame:
    """Every row once a language; the languages are an option, so they travel inside the expression."""
    return frame.withColumn(name, F.explode(F.array(*(F.lit(x) for x in langs))))


def last_write_wins(outputs: DataFrame, path: str, order: list[str], value: str) -> DataFrame:
    """One row a path: the value written last, and how many were."""
    return outputs.groupBy(path).agg(F.max(F.struct(*order, value)).getField(value).alias(value), F.count("*").alias("writes"))


#: With more paths that are written more than once, all outputs are grouped by shuffle.
BROADCAST_CLASHES = 100_000


def outputs_once(outputs: DataFrame, path: str, order: list[str], value: str) -> DataFrame:
    """As ``last_write_wins``; the values of paths that are written once aren't shuffled."""
    twice = outputs.groupBy(path).agg(F.count("*").alias("n")).where("n > 1").select(path)
    if twice.limit(BROADCAST_CLASHES + 1).count() > BROADCAST_CLASHES:
        return last_write_wins(outputs, path, order, value)
    single = outputs.join(F.broadcast(twice), path, "left_anti").select(path, value, F.lit(1).cast("bigint").alias("writes"))
    return single.unionByName(last_write_wins(outputs.join(F.broadcast(twice), path, "left_semi"), path, order, value))
