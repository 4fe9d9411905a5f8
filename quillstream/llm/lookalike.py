"""Problem 2: one form for all texts that a reader cannot tell apart, by DuckDB SQL inside Arrow partitions.

Each Arrow batch is a DuckDB table; its SQL drops invisible characters, maps kinds of space and hyphen, compatibility forms and
look-alike letters, and composes accents before and after (a look-alike base letter composes only once it is mapped).
Compatibility forms follow from the decompositions of Unicode by a rule (``_compatible``): widths, small and Arabic
presentation forms, letters and numerals that stand for several letters. Superscripts, circled digits, signs like the
numero sign, fractions, mathematical letters, quotes, dotless i and numbers of spaces stay: they show. Look-alike letters are
listed below; ``read_confusables`` takes more from a table in the format of Unicode's confusables.

What comes out is a form for each text, the members of each form, and counts (``forms``); the pairs that a query may ask
for follow from these (``look_alike_pairs``).

Defined results: null stays null, empty stays empty; texts of any length are mapped whole; repeated rows stay repeated;
extra columns pass through unseen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstream.functions.skew import lookup_join
from quillstream.llm.common import checkpoint

# Letters of other scripts that look like Latin ones.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ё": "Ë", "Ѐ": "È", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ё": "ë", "ѐ": "è", "ү": "y", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    "Ά": "Á", "Έ": "É", "Ή": "H́", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "ο": "o", "ό": "ó", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
}
OTHER = {"ı̇": "i", "ɡ": "g", "ɑ": "a", "Օ": "O", "օ": "o", "Տ": "S", "հ": "h", "ո": "n", "ս": "u", "Ꭺ": "A", "Ꮯ": "C", "Ꭼ": "E"}
HYPHENS = {"\u2010": "-", "\u2011": "-"}
#: Besides the format characters (category Cf) and variation selectors, which a rule gives.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"


def _invisible() -> str:
    kept = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or 0x180B <= c <= 0x180F)]
    return "".join([*(c for c in kept if unicodedata.name(c, "").split(" ")[0] != "ARABIC"), *INVISIBLE])


def _compatible() -> dict[str, str]:
    """Characters that look like what they decompose into: other widths, small forms, forms of Arabic letters by their place,
    and letters or Roman numerals that stand for several letters or for one capital."""
    found = {}
    for code in range(0x110000):
        char = chr(code)
        tag, _, rest = unicodedata.decomposition(char).partition(" ")
        if not tag.startswith("<") or char in INVISIBLE or unicodedata.category(char) == "Zs":
            continue
        plain = unicodedata.normalize("NFKC", char)
        letters = all(unicodedata.category(c)[0] in "LM" for c in plain)
        several = len(rest.split()) > 1 and unicodedata.category(char)[0] == "L" or unicodedata.category(char) == "Nl"
        if tag in ("<wide>", "<narrow>", "<small>") or tag in ("<initial>", "<medial>", "<final>", "<isolated>") and letters or tag == "<compat>" and letters and several:
            found[char] = plain
    return {k: {"゙": "゙", "゚": "゚"}.get(v, v) for k, v in found.items()}


def read_confusables(lines: Iterator[str]) -> dict[str, str]:
    """Single letters of other scripts that a published table (code points; code points; type) maps to Latin ones."""
    found = {}
    for line in lines:
        fields = [f.strip() for f in line.split("#")[0].lstrip("\ufeff").split(";")]
        if len(fields) >= 2 and fields[0] and fields[1]:
            old, new = ("".join(chr(int(x, 16)) for x in f.split()) for f in fields[:2])
            if len(old) == 1 and old.isalpha() and new.isascii() and new.isalpha() and not old.isascii():
                found[old] = new
    return found


SPACES = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs" and c != 0x20)
_ALL = _compatible() | HYPHENS | CYRILLIC | GREEK | OTHER
_SINGLE = {k: v for k, v in _ALL.items() if len(k) == len(v) == 1} | dict.fromkeys(SPACES, " ")
_LONGER = {k: v for k, v in _ALL.items() if not len(k) == len(v) == 1}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str) -> str:
    """The mapping as one DuckDB expression. What becomes several characters is replaced only in texts that hold any of it."""
    drop = "".join(f"\\x{{{ord(c):X}}}" for c in _invisible())
    sql = plain = f"nfc_normalize(regexp_replace({column}, '[{drop}]', '', 'g'))"
    for old, new in _LONGER.items():
        sql = f"replace({sql}, {_quoted(old)}, {_quoted(new)})"
    some = "|".join(_LONGER)
    return f"nfc_normalize(translate(CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]') AND regexp_matches({plain}, {_quoted(some)}) THEN {sql} ELSE {plain} END, {_quoted(''.join(_SINGLE))}, {_quoted(''.join(_SINGLE.values()))}))"


_DROP = dict.fromkeys(map(ord, _invisible()))
_MAP = str.maketrans(_SINGLE | {k: v for k, v in _LONGER.items() if len(k) == 1})
_SEQUENCES = {k: v for k, v in _LONGER.items() if len(k) > 1}
_MAPPED = frozenset(map(chr, {*_DROP, *_MAP}))


def canonical_text(text: str) -> str:
    """The same mapping for single strings in Python; tests hold both against each other."""
    if text.isascii():
        return text
    mapped = not _MAPPED.isdisjoint(text)
    found = unicodedata.normalize("NFC", text.translate(_DROP) if mapped else text)
    for old, new in _SEQUENCES.items():
        if old in found:
            found = found.replace(old, new)
    # what composing brings about may be mapped too
    return unicodedata.normalize("NFC", found.translate(_MAP)) if mapped or (found != text and not _MAPPED.isdisjoint(found)) else found


def canonicalise(frame: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``frame`` with the canonical form of ``text`` in ``out``."""
    kept = [c for c in frame.columns if c != out]
    frame = frame.select(*(F.col(f"`{c}`") for c in kept))
    names = {c: f"c{n}" for n, c in enumerate(kept)}  # clashing or odd names don't reach the SQL
    sql = f"SELECT *, {canonical_sql(names[text])} AS out FROM batch"
    schema = StructType([*frame.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            if not batch.num_rows:
                continue
            con.register("batch", pa.Table.from_batches([batch.rename_columns([names[c] for c in kept])]))
            for part in con.execute(sql).to_arrow_table().to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, part.column(part.num_columns - 1)] if part.num_rows == batch.num_rows else part.columns, names=[*kept, out])
            con.unregister("batch")
        con.close()

    return frame.mapInArrow(run, schema)


def _members(frame: DataFrame, key: str, text: str) -> DataFrame:
    rows = frame.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").distinct()
    return canonicalise(rows, "text").select("key", F.unhex(F.sha2("text", 256)).alias("raw"), F.unhex(F.sha2("canonical", 256)).alias("form"))


def forms(frame: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Forms (form, spellings, rows) and members (form, raw, key): hashes of the form and of the text as it is, each text of a key once."""
    members = checkpoint(_members(frame, key, text))
    spellings = members.groupBy("form", "raw").agg(F.count("*").alias("n"))
    return spellings.groupBy("form").agg(F.count("*").alias("spellings"), F.sum("n").alias("rows")), members


#: Spellings, or rows of a spelling, that meet in one task.
BLOCK = 1000


def _blocked(frame: DataFrame, key: str, count: str) -> DataFrame:
    """``frame`` with its block, of as many as ``count`` needs."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    return frame.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))


def look_alike_pairs(frame: DataFrame, key: str, text: str) -> DataFrame:
    """<key>_a < <key>_b: all pairs of keys whose texts look the same without being the same string.

    Only for those who need pairs, whose number grows with the square of a form's rows. The spellings (distinct strings) of a
    form are paired, then the rows of two spellings; both go in blocks, so that no task has more than ``BLOCK`` squared pairs
    of one form, however many share it. A form of one spelling makes no pair.
    """
    groups, members = forms(frame, key, text)
    several = groups.where("spellings > 1")
    counted = members.groupBy("form", "raw").agg(F.count("*").alias("n"))
    variants = _blocked(lookup_join(counted, several.select("form", F.col("spellings").alias("of"), "spellings"), ["form"], "spellings"), "raw", "of")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = variants.select("form", F.col("raw").alias("raw_a"), F.col("n").alias("n_a"), F.col("block").alias("x"), every.alias("y"))
    other = variants.select("form", F.col("raw").alias("raw_b"), F.col("n").alias("n_b"), F.col("block").alias("y"), every.alias("x"))
    pairs = one.join(other, ["form", "x", "y"]).where("raw_a < raw_b")
    rows = _blocked(lookup_join(members, variants.select("form", "raw", "n", F.col("n").alias("of")), ["form", "raw"], "n"), "key", "of").select("raw", "key", "block")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1))
    blocks = pairs.withColumn("block_a", number("n_a")).withColumn("block_b", number("n_b")).select("raw_a", "block_a", "raw_b", "block_b")
    first = blocks.join(rows.select(F.col("raw").alias("raw_a"), F.col("block").alias("block_a"), F.col("key").alias("a")), ["raw_a", "block_a"]).select("a", "raw_b", "block_b")
    both = first.join(rows.select(F.col("raw").alias("raw_b"), F.col("block").alias("block_b"), F.col("key").alias("b")), ["raw_b", "block_b"]).where("a != b")
    return both.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
