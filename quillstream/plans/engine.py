"""The whole dataflow: changed documents, chunks, memory, batches, translations, checks, documents, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import combined_glob, glob_regex, sha256_hex, slashes
from quillstream.model import HEADER_PREFIX
from quillstream.operators import chunks as chunk_ops
from quillstream.operators import diff, glossary, memory, paths, provenance, report, translate
from quillstream.plans import batching, pages
from quillstream.sources.shared import written

# A fixed value: what is said of a chunk that stays as its source.
LOST = ": kept dropping required markers after repair attempts; left untranslated."


@dataclass
class Result:
    changed: DataFrame
    translations: DataFrame
    documents: DataFrame
    titled: DataFrame
    memory: DataFrame
    events: DataFrame
    languages: DataFrame

    @cached_property
    def outputs(self) -> DataFrame:
        """What is written where; whether paths clash is looked up when it is asked for."""
        return paths.outputs_once(self.titled, "output_path", ["path", "target_lang"], "markdown")


def stale(head: DataFrame, langs: list[str], existing: DataFrame, template: str = "docs/{lang}/{relativePath}", source_path: str = "docs", include: str | None = None, ignored: list[str] | None = None) -> DataFrame:
    """Events of the outputs that ``existing`` (path, body) holds for the sources ``head`` (path, source_hash) and that aren't up to date.

    It needs hashes and headers only, nothing that a run translates.
    """
    pattern = None if include is None else combined_glob(source_path, include)
    known = head if pattern is None else head.where(slashes(F.col("path")).rlike(glob_regex(pattern)))
    known = known.where(~diff.is_ignored(F.col("path"), ignored)) if ignored else known
    found = provenance.drift(provenance.existing_outputs(known, langs, template, source_path, existing), head).where("is_stale")
    return found.select(F.lit("stale").alias("category"), "path", "target_lang", F.col("warning").alias("message"))


def run(
    corpus: DataFrame,
    base: DataFrame,
    langs: list[str],
    remembered: DataFrame,
    terms: DataFrame,
    existing: DataFrame | None = None,
    make: Callable[[], translate.Translator] = translate.FakeTranslator,
    template: str = "docs/{lang}/{relativePath}",
    source_path: str = "docs",
    include: str | None = None,
    ignored: list[str] | None = None,
    generated_at: str = "1970-01-01T00:00:00.0000000+00:00",
    budget: int = batching.BUDGET,
    parallel: int = 4,
    prefix: str = HEADER_PREFIX,
) -> Result:
    """``corpus`` (path, body, and source_hash if the files' own bytes were hashed) against ``base`` (path, source_hash), into ``langs``.

    Every changed document is written in every language, one without chunks as it is. If a chunk has no answer in a language,
    that document isn't written there, so that no header calls it fresh; it is an event and is asked for again next time,
    while the answers that there are stay in the memory. The memory keeps validated texts; a remembered text without its
    markers is repaired as an answer would be. Glossary checks read the first answer. ``include`` is a pattern below
    ``source_path``. Outputs of all sources that ``existing`` (path, body) holds are audited for drift as they were before this run.
    """
    source_hash = F.col("source_hash") if "source_hash" in corpus.columns else sha256_hex(F.encode("body", "UTF-8"))
    head = corpus.select("path", source_hash.alias("source_hash"))
    pattern = None if include is None else combined_glob(source_path, include)
    changed = diff.changed_files(base, head, pattern, ignored)
    bodies = corpus.select("path", "body", source_hash.alias("source_hash")).join(changed.select("path"), "path", "left_semi")
    sources = diff.not_generated(bodies, "body", prefix)
    # a line a language, which is part of every prompt anyway
    hint = {r.target_lang: r.hint for r in glossary.hints(terms, langs).collect()}
    # written before it is read twice
    settled = written(pages.settle(pages.with_memory(sources, remembered), langs, hint, make, parallel, budget))
    said = settled.select("path", "target_lang", F.explode("answers").alias("a")).select("path", "target_lang", "a.*")
    answered = said.select("path", "ordinal", chunk_ops.chunk_id(F.col("path"), F.col("ordinal")).alias("chunk_id"), "target_lang", "source_text", sha256_hex(F.col("source_text")).alias("content_hash"), "attempts", "from_cache", "kept", "error")
    rebuilt = settled.drop("answers", "source_hash")
    whole = settled.where("error is null and markdown is not null")
    relative = paths.source_relative(F.col("path"), source_path)
    titled = whole.select("path", "target_lang", paths.output_path(template, F.col("target_lang"), relative).alias("output_path"), provenance.with_header(provenance.header(F.col("source_hash"), F.col("path"), F.col("target_lang"), F.lit(generated_at), prefix), F.col("markdown")).alias("markdown"))
    lost = whole.select("path", "target_lang", F.explode("untranslated").alias("ordinal")).withColumn("lost", F.lit(True))
    fixed = whole.select("path", "target_lang", F.explode("repaired").alias("ordinal")).withColumn("fixed", F.lit(True))
    judged = answered.join(lost, ["path", "target_lang", "ordinal"], "left").join(fixed, ["path", "target_lang", "ordinal"], "left")
    kept = judged.where("kept and lost is null and (not from_cache or size(attempts) > 1)").select("path", "target_lang", "content_hash", F.element_at("attempts", -1).alias("translated_text"), "ordinal")
    new_memory = memory.upsert(remembered, kept, "ordinal")
    where = F.concat("path", F.lit(" ["), "target_lang", F.lit("]"))
    firsts = answered.where("size(attempts) > 0").select(F.col("chunk_id").alias("id"), "path", "target_lang", "source_text", F.element_at("attempts", 1).alias("translated_text"))
    checked = glossary.warnings(firsts, terms)
    events = [
        checked.select(F.lit("glossary").alias("category"), "path", "target_lang", F.concat(where, F.lit(": "), "warning").alias("message")),
        judged.where("fixed").select(F.lit("healed").alias("category"), "path", "target_lang", F.concat(where, F.lit(" chunk "), "chunk_id").alias("message")),
        judged.where("lost").select(F.lit("untranslated").alias("category"), "path", "target_lang", F.concat(where, F.lit(" chunk "), "chunk_id", F.lit(LOST)).alias("message")),
        rebuilt.where("error is not null").select(F.lit("skipped").alias("category"), "path", "target_lang", F.concat(where, F.lit(": "), "error").alias("message")),
    ]
    if existing is not None:
        events.append(stale(head, langs, existing, template, source_path, include, ignored))
    every = events[0]
    for e in events[1:]:
        every = every.unionByName(e)
    sound = settled.where("error is null").select("target_lang", F.explode("answers.from_cache").alias("from_cache"))
    return Result(changed, answered, rebuilt, titled, new_memory, every, report.lang_summary(sound, langs))
