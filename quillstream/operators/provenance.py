"""Provenance headers and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import trimmed
from quillstream.model import HEADER_PREFIX, HEADER_SUFFIX
from quillstream.operators.paths import output_path, per_language, source_relative

# Keys of a header, and the reasons of a verdict.
REQUIRED = {"source-hash": "source_hash", "source-path": "source_path", "target-lang": "target_lang", "generated": "generated_raw"}
NO_HEADER = "No provenance header found in existing translation."
CHANGED = "Source file changed since this translation was generated."
FRESH = "Up to date."
GONE = ("Source file '", "' no longer exists.")


def header(source_hash: Column, path: Column, lang: Column, generated_raw: Column, prefix: str = HEADER_PREFIX) -> Column:
    """One comment line; the time is a text, as it may have more digits than a timestamp keeps."""
    return F.concat(F.lit(f"{prefix} source-hash="), source_hash, F.lit("; source-path="), path, F.lit("; target-lang="), lang, F.lit("; generated="), generated_raw, F.lit(f" {HEADER_SUFFIX}"))


def generated_text(ts: Column) -> Column:
    """A timestamp with seven fraction digits and its offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSxxx")


def with_header(head: Column, body: Column) -> Column:
    return F.concat(head, F.lit("\n\n"), body)


def parse_header(content: Column, prefix: str = HEADER_PREFIX) -> Column:
    """Struct of the four fields and the time, or null: only the first line counts, it must begin and end as a header does,
    every part must be key=value, of a key given twice the last counts, all four must be there and the time be one."""
    line = F.rtrim(F.substring_index(content, "\n", 1), F.lit("\r"))
    size = F.length(line) - len(prefix) - len(HEADER_SUFFIX)
    is_header = F.startswith(line, F.lit(prefix)) & F.endswith(line, F.lit(HEADER_SUFFIX)) & (size >= 0)
    body = F.when(is_header, F.substring(line, F.lit(len(prefix) + 1), size))
    parts = F.filter(F.transform(F.split(body, ";"), trimmed), lambda p: p != "")
    sound = ~F.exists(parts, lambda p: ~F.contains(p, F.lit("=")))

    fields = {name: _value(parts, key) for key, name in REQUIRED.items()}
    generated = F.try_to_timestamp(fields["generated_raw"])
    whole = is_header & sound & generated.isNotNull()
    for c in fields.values():
        whole = whole & c.isNotNull()
    return F.when(whole, F.struct(*(c.alias(n) for n, c in fields.items()), generated.alias("generated")))


def _value(parts: Column, key: str) -> Column:
    own = F.filter(parts, lambda p: trimmed(F.substring_index(p, "=", 1)) == F.lit(key))
    return trimmed(F.regexp_replace(F.get(F.reverse(own), F.lit(0)), "(?s)^[^=]*=", ""))


def verdict(parsed: Column, exists: Column, path: Column, current_hash: Column) -> tuple[Column, Column]:
    """Whether a translation is stale, and why, in this order: no header, no source, same hash, another hash."""
    fresh = F.coalesce(parsed.getField("source_hash") == current_hash, F.lit(False))
    stale = parsed.isNull() | ~exists | ~fresh
    gone = F.concat(F.lit(GONE[0]), path, F.lit(GONE[1]))
    return stale, F.when(parsed.isNull(), NO_HEADER).when(~exists, gone).when(fresh, FRESH).otherwise(CHANGED)


def existing_outputs(sources: DataFrame, langs: list[str], template: str, source_path: str, tree: DataFrame) -> DataFrame:
    """output_path, path, target_lang, content: what ``tree`` (path, body) holds for ``sources`` (path) in each language.

    Outputs that were never written are no rows.
    """
    places = per_language(sources.select("path"), langs)
    named = places.withColumn("output_path", output_path(template, F.col("target_lang"), source_relative(F.col("path"), source_path)))
    return named.join(tree.select(F.col("path").alias("output_path"), F.coalesce("body", F.lit("")).alias("content")), "output_path").select("output_path", "path", "target_lang", "content")


def drift(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """``outputs`` (output_path, path, target_lang, content) with is_stale, reason and warning, judged against ``sources`` (path, source_hash).

    Outputs that were never written are not in ``outputs`` and so no drift.
    """
    known = sources.select("path", "source_hash", F.lit(True).alias("_exists"))
    rows = outputs.withColumn("_header", parse_header(F.col("content"))).drop("content").join(known, "path", "left")
    stale, reason = verdict(F.col("_header"), F.col("_exists").isNotNull(), F.col("path"), F.col("source_hash"))
    judged = rows.withColumn("is_stale", stale).withColumn("reason", reason)
    return judged.select("output_path", "path", "target_lang", "is_stale", "reason", F.when(F.col("is_stale"), F.concat("output_path", F.lit(" ["), "target_lang", F.lit("]: "), "reason")).alias("warning"))
