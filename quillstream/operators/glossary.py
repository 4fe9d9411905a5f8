"""Glossary terms: loading, prompt hints, checks of translations.

Terms are rows (term_kind dont_translate or mapping, lang, src, tgt, case_sensitive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.skew import lookup_join
from quillstream.functions.text import whole_word, word_start
from quillstream.model import GLOSSARY
from quillstream.sources.shared import ensure_checkpoint_dir

# How a hint begins.
VERBATIM = "These terms must appear verbatim, untranslated, in the output: "
RENDERED = "These source terms must be rendered exactly as specified: "
# What a warning says around the term, its rendering and the language.
TERM_LOST = ("Glossary term '", "' was expected verbatim in the translation but was not found.")
MAPPING_LOST = ("Glossary mapping '", "' -> '", "' (", ") was not found in the translation.")
#: A glossary of more terms isn't broadcast but joined by shuffle.
BROADCAST_TERMS = 100_000


def terms_of_json(frame: DataFrame, column: str) -> DataFrame:
    """Rows of glossary documents. Terms that are the same under the document's own case rule count once; null documents are an error."""
    checked = F.when(F.col(column).isNull() | (F.trim(column) == "null"), F.raise_error(F.lit("The glossary is empty or invalid.")).cast("string")).otherwise(F.col(column))
    parsed = frame.select(F.from_json(checked, GLOSSARY).alias("g"))
    sensitive = F.coalesce("g.case_sensitive", F.lit(True)).alias("case_sensitive")
    plain = parsed.select(F.lit("dont_translate").alias("term_kind"), F.lit(None).cast("string").alias("lang"), F.explode("g.dont_translate").alias("src"), F.lit(None).cast("string").alias("tgt"), sensitive)
    once = plain.dropDuplicates(["src"]).groupBy("term_kind", "lang", "tgt", "case_sensitive", F.when(F.col("case_sensitive"), F.col("src")).otherwise(F.lower("src")).alias("k")).agg(F.min("src").alias("src")).drop("k")
    langs = parsed.select(F.explode("g.custom_mappings").alias("lang", "m"), sensitive)
    mapped = langs.select(F.lit("mapping").alias("term_kind"), "lang", F.explode("m").alias("src", "tgt"), "case_sensitive")
    return once.select("term_kind", "lang", "src", "tgt", "case_sensitive").unionByName(mapped)


def lang_code(c: Column) -> Column:
    """A language label as its two-letter code."""
    return F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2})", 1))


def usable(terms: DataFrame) -> DataFrame:
    """Terms that can be checked: they have a source term, mappings a language and a rendering, and none holds a quoting mark."""
    lang = lang_code(F.col("lang"))
    rows = terms.select("term_id", "term_kind", lang.alias("lang"), "src", "tgt", F.coalesce("case_sensitive", F.lit(True)).alias("case_sensitive"))
    mapped = (F.col("term_kind") == "mapping") & (F.col("lang") != "") & F.col("tgt").isNotNull()
    return rows.where(F.col("src").isNotNull() & (F.col("src") != "") & ~F.contains("src", F.lit("\\E")) & ((F.col("term_kind") == "dont_translate") | mapped))


def hints(terms: DataFrame, langs: list[str]) -> DataFrame:
    """target_lang, hint of every language: verbatim terms in order of their ids, then its mappings; empty where there is neither.

    Aggregates a table of one row a term; what comes out is part of a prompt, which bounds it.
    """
    spark: SparkSession = terms.sparkSession
    asked = spark.createDataFrame([(x,) for x in langs], "target_lang string")
    rows = usable(terms)

    def joined(c: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term_id", c.alias("t")))), lambda x: x["t"]), ", ")

    plain = rows.where("term_kind = 'dont_translate'").agg(joined(F.col("src")).alias("plain"))
    pairs = rows.where("term_kind = 'mapping'").groupBy(F.col("lang").alias("target_lang")).agg(joined(F.concat(F.lit('"'), "src", F.lit('" -> "'), "tgt", F.lit('"'))).alias("pairs"))
    both = asked.withColumn("one", F.lit(1)).join(plain.withColumn("one", F.lit(1)), "one").join(pairs, "target_lang", "left")
    first = F.when(F.coalesce("plain", F.lit("")) != "", F.concat(F.lit(VERBATIM), "plain", F.lit(". "))).otherwise("")
    second = F.when(F.coalesce("pairs", F.lit("")) != "", F.concat(F.lit(RENDERED), "pairs", F.lit("."))).otherwise("")
    return both.select("target_lang", F.concat(first, second).alias("hint"))


def _met_by_shuffle(rows: DataFrame, known: DataFrame, words: Column, own: Column) -> DataFrame:
    """Pairs with the terms whose first word they have. Only numbers and words are shuffled, those that no term begins with fall
    away, a word that very many pairs have is no hot task, and the texts come back to the few that met a term."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    ensure_checkpoint_dir(rows.sparkSession)
    numbered = numbered.checkpoint()
    single = numbered.select("row", "lang", F.explode(words).alias("word"))
    counts = single.groupBy("word").agg(F.count("*").alias("n"))
    fields = ["term_id", "term_kind", "term_lang", "src", "tgt", "case_sensitive"]
    of_word = known.groupBy("word").agg(F.collect_list(F.struct(*fields)).alias("terms")).join(counts, "word")
    met = lookup_join(single, of_word, ["word"], "n").select("row", "lang", F.explode("terms").alias("t")).select("row", "lang", "t.*").where(own)
    return met.drop("lang").join(numbered, "row")


def warnings(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """``pairs`` (id, path, target_lang, source_text, translated_text) with a warning for each term that is a whole word of the
    source but missing in the translation: verbatim terms as whole words, renderings at a word's start.

    A pair meets only the terms whose first word it has: its distinct words are the join key, no product of pairs and terms.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("source_text"), r"(?U)[^\p{L}\p{M}\p{N}_]+"), lambda w: w != ""))
    rows = pairs.where("source_text is not null and translated_text is not null").select("id", "path", "target_lang", "source_text", "translated_text", lang_code(F.col("target_lang")).alias("lang"))
    first = F.get(F.filter(F.split(F.lower("src"), r"(?U)[^\p{L}\p{M}\p{N}_]+"), lambda w: w != ""), F.lit(0))
    known = usable(terms).withColumn("word", first).where("word is not null").withColumnRenamed("lang", "term_lang")
    own = (F.col("term_kind") == "dont_translate") | (F.col("term_lang") == F.col("lang"))
    if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        met = rows.withColumn("word", F.explode(words)).join(F.broadcast(known), "word").where(own)
    else:
        met = _met_by_shuffle(rows, known, words, own)
    here = F.rlike("source_text", whole_word(F.col("src"), F.col("case_sensitive")))
    verbatim = F.rlike("translated_text", whole_word(F.col("src"), F.col("case_sensitive")))
    rendered = F.rlike("translated_text", word_start(F.col("tgt"), F.col("case_sensitive")))
    lost = met.where(here & F.when(F.col("term_kind") == "dont_translate", ~verbatim).otherwise(~rendered))
    text = F.when(F.col("term_kind") == "dont_translate", F.concat(F.lit(TERM_LOST[0]), "src", F.lit(TERM_LOST[1]))).otherwise(
        F.concat(F.lit(MAPPING_LOST[0]), "src", F.lit(MAPPING_LOST[1]), "tgt", F.lit(MAPPING_LOST[2]), "target_lang", F.lit(MAPPING_LOST[3]))
    )
    return lost.select("id", "path", "target_lang", "term_id", "term_kind", text.alias("warning"))
