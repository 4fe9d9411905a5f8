"""Problem 3: copies of records under other formatting, by dictionary encoding of their fields.

Each distinct raw value of a field is canonicalised once (letters and digits only, case folded) and gets an integer; a
record becomes the tuple of its fields' integers in the order of the field names, and the compact tuples are grouped.
Integers are dense, not hashes: canonical values, by their SHA-256, are numbered inside a bucket of about ``BUCKET_ROWS`` of
them, as many buckets as the records need, the bucket's number being the high bits. Raw values travel once each; the
records carry only their digests. A value that very many records spell, alike or each in a way of its own, is no hot task.

Vowel signs and other marks that make up letters count with them; accents that stand by themselves (the blocks of combining
diacritics) are disregarded, as the composed letter is another one.

Defined results: a null field equals null only (and differs from one without letters or digits); a payload that is no
JSON object is compared by its own letters and digits and is no copy of a proper record; a field given twice counts by
its first value; of equal record ids one counts; order and spelling of field names don't matter; other fields are not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.functions.skew import HOT_ROWS, lookup_join
from quillstream.llm.common import checkpoint

BUCKET_ROWS = 20_000
FIELDS = ("blockkind", "sourcefilepath", "sourcetext")
NO_RECORD = "payload"
#: Marks that are no part of a letter's own: combining diacritics, enclosing marks, half marks, variation selectors.
ACCENTS = r"\x{300}-\x{36F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE00}-\x{FE2F}\x{E0100}-\x{E01EF}"


def letters_and_digits(value: Column) -> Column:
    """Upper case first, so that letters that differ only in one of their cases meet (sharp s and double s, dotless i and i).

    The optimiser drops an upper() right inside a lower(), which are not the same; hence the pattern between them.
    """
    other = rf"[^\p{{L}}\p{{N}}\p{{M}}]|[{ACCENTS}]"
    return F.regexp_replace(F.lower(F.regexp_replace(F.upper(value), other, "")), other, "")


def fields(payload: Column, names: tuple[str, ...] = FIELDS) -> list[Column]:
    """Values of a JSON object's fields, whatever the style of their names."""
    entries = F.map_entries(F.from_json(payload, "map<string,string>", {"mode": "PERMISSIVE"}))

    def named(name: str) -> Column:
        return F.get(F.filter(entries, lambda e: F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "") == name), F.lit(0))["value"].alias(name)

    return [named(n) for n in names]


def encoded(frame: DataFrame, key: str, payload: str, names: tuple[str, ...] = FIELDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """key and the integer of each field; 0 is null. The column ``payload`` holds the integer of what is no record."""
    names = tuple(sorted(names))
    raw = frame.select(F.col(key).alias("key"), F.col(payload).alias("raw"))
    is_record = F.coalesce(F.size(F.map_keys(F.from_json("raw", "map<string,string>"))), F.lit(-1)) >= 0
    values = raw.select("key", *fields(F.col("raw"), names), F.when(~is_record, F.coalesce("raw", F.lit(""))).alias(NO_RECORD))
    every = (*names, NO_RECORD)
    digest = lambda n: F.when(F.col(n).isNotNull(), F.unhex(F.sha2(F.concat(F.lit(f"{n}\0"), F.col(n)), 256)))
    records = checkpoint(values.select("key", *(digest(n).alias(n) for n in every)))
    # the pairs of field and raw value, each once; duplicates fall away before the shuffle
    pairs = values.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), digest(n).alias("digest")) for n in every))).alias("p")).select("p.*").where("value is not null")
    distinct = pairs.groupBy("field", "digest").agg(F.any_value("value").alias("value"), F.count("*").alias("n"))
    canonical = checkpoint(distinct.select("digest", "field", "n", F.unhex(F.sha2(letters_and_digits(F.col("value")), 256)).alias("form")))
    # numbered by form, each once: a form with very many spellings is one row here
    forms = canonical.groupBy("field", "form").agg(F.count("*").alias("spellings"))
    buckets = 1 << min(22, max(6, (canonical.count() // BUCKET_ROWS).bit_length()))
    bucket = F.pmod(F.xxhash64("field", "form"), F.lit(buckets))
    ranked = Window.partitionBy("bucket").orderBy("field", "form")
    numbered = forms.withColumn("bucket", bucket).withColumn("number", F.shiftleft(F.col("bucket") + 1, 40) + F.row_number().over(ranked))
    numbers = checkpoint(lookup_join(canonical, numbered.select("field", "form", "number", "spellings"), ["field", "form"], "spellings", hot_rows).select("field", "digest", "number", "n"))
    for name in every:
        own = numbers.where(F.col("field") == name).select(F.col("digest").alias(name), F.col("number").alias("number"), "n")
        records = lookup_join(records, own, [name], "n", hot_rows, "left").drop(name).withColumnRenamed("number", name)
    return records.select("key", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in every))


def copies(frame: DataFrame, key: str, payload: str, names: tuple[str, ...] = FIELDS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Groups (first key, number of copies) and members (first key, key) of groups of two or more."""
    rows = checkpoint(encoded(frame, key, payload, names, hot_rows))
    tuple_of = [*sorted(names), NO_RECORD]
    groups = rows.groupBy(*tuple_of).agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    several = groups.where("copies > 1")
    members = lookup_join(rows, several, tuple_of, "copies", hot_rows)
    return groups.select("first", "copies"), members.select("first", "key")
