"""Queries of the training-data operators, by the numbers of the problems; SQL where it can express them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import dictcopies, langid, leaks, lookalike, packing, pairs, splitting
from quillstream.llm.common import checkpoint, table
from quillstream.sources.shared import ensure_checkpoint_dir, spread


def label_code(label: Column) -> Column:
    """Two lower-case letters, or null where a label holds no language code."""
    code = F.regexp_extract(label, r"^\s*([A-Za-z]{2})(?:[-_][A-Za-z0-9]{2,8})*\s*$", 1)
    return F.when(code != "", F.lower(code))


def _language_model(spark: SparkSession, d: str) -> langid.LanguageModel:
    return langid.train(spark, [(table(spark, d, "documents"), "doc_id", "lang", "text"), (table(spark, d, "translations"), "translation_id", "target_lang", "translated_text")])


_LABELLED = [("documents", "doc_id", "lang", "text"), ("translation_results", "result_id", "target_language", "output_markdown")]


def _detected(spark: SparkSession, d: str, only_foreign: bool) -> DataFrame:
    model, parts = _language_model(spark, d), []
    for name, key, label, text in _LABELLED:
        frame = table(spark, d, name)
        parts.append(langid.detect(frame, key, text, model, only_foreign, label).withColumn("table_name", F.lit(name)))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = _detected(spark, d, only_foreign=True)
    code = label_code(F.col("label"))
    wrong = (F.col("block_no") > 0) | code.isNull() | (code != F.col("lang"))
    return found.where(F.col("lang").isNotNull() & wrong).select("table_name", "row_id", "block_no", "lang")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every page and every block of prose with its language and confidence."""
    return _detected(spark, d, only_foreign=False).select("table_name", "row_id", "block_no", "lang", F.round("confidence", 4).alias("confidence"), "letters")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "chunks"), "chunk_id", "source_text")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The hash that equal-looking chunks share, beside that of the text as received."""
    rows = table(spark, d, "chunks").select("chunk_id", "source_text").distinct()
    return lookalike.canonicalise(rows, "source_text").select("chunk_id", F.sha2("source_text", 256).alias("text_hash"), F.sha2("canonical", 256).alias("canonical_hash"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form with the number of its spellings and of the chunks that have it."""
    groups, _ = lookalike.forms(table(spark, d, "chunks"), "chunk_id", "source_text")
    return groups.select(F.lower(F.hex("form")).alias("canonical_hash"), "spellings", "rows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, members = dictcopies.copies(table(spark, d, "chunk_records"), "record_id", "payload")
    return members.where("key > first").select(F.col("first").alias("record_id_a"), F.col("key").alias("record_id_b"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One record a group and the number of its copies, itself included."""
    groups, _ = dictcopies.copies(table(spark, d, "chunk_records"), "record_id", "payload")
    return groups.select(F.col("first").alias("record_id"), "copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "documents").select(F.col("lang").alias("label"), "text")
    paired = checkpoint(pairs.pairs(table(spark, d, "chunks"), "chunk_id", "source_text", "ingested_at", table(spark, d, "translations"), "translation_id", "target_lang", "translated_text"))
    paired = spread(paired)
    found = pairs.defects(paired, pairs.fit(paired, labelled))
    return found.select(F.col("id").alias("translation_id"), "defect")


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text."""
    return packing.pack(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """The fill of every container."""
    return packing.fill(p5_containers(spark, d))


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every text whether its pieces are all there, follow one another, and lie in containers that aren't over their capacity."""
    packed = p5_containers(spark, d)
    full = packing.fill(packed).select("container_id", (F.col("tokens") <= packing.CAPACITY).alias("fits"))
    rows = packed.join(full, "container_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pieces").alias("pieces"), F.sum("piece_no").alias("places"), F.sum(F.col("first_token") - F.col("piece_no").cast("long") * packing.CAPACITY).alias("off"), F.max("tokens").alias("most"), F.bool_and("fits").alias("fits"))
    whole = (F.col("n") == F.col("pieces")) & (F.col("places") == F.col("n") * (F.col("n") - 1) / 2) & (F.col("off") == 0) & (F.col("most") <= packing.CAPACITY)
    return rows.select("doc_id", whole.alias("whole"), "fits")


def p5_waste(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers are no more than the fewest that could do and a twentieth."""
    filled = packing.fill(p5_containers(spark, d)).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / packing.CAPACITY)
    return filled.select((F.col("n") >= least).alias("possible"), (F.col("n") <= F.ceil(least * 1.05) + 1).alias("tight"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the passages that the search for near ones verifies, those without an edit."""
    return _leaks(spark, d).where("edits = 0").select("doc_id", "item_id")


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages with up to one word changed, added or lost in twelve."""
    return _leaks(spark, d)


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every text of documents in pieces of at most 512 tokens, 64 of them shared with the piece before."""
    return splitting.split(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """All pages as a few large files of the shared folder, cut by ranges of bytes that tasks seek to; doc_id is the file's number."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/p7-files-{uuid.uuid4().hex}"
    return splitting.split_files(spark, splitting.files_of(table(spark, d, "documents"), "doc_id", "text", folder))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces without their overlaps; whether all are within the limit and overlap as asked."""
    pieces = p7_pieces(spark, d)
    new = F.expr("substring(text, cast(new_from - start + 1 AS int))")
    rows = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", new.alias("t")))).alias("p"), F.max("tokens").alias("most"), F.bool_and((F.col("piece_no") == 0) | (F.col("start") <= F.col("new_from"))).alias("overlaps"))
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("p", lambda x: x["t"]), ""), 256).alias("text_hash"), (F.col("most") <= splitting.LIMIT).alias("within"), "overlaps")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p2_found": p2_found,
    "p2_canonical": p2_canonical,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p5_containers": p5_containers,
    "p5_fill": p5_fill,
    "p5_whole": p5_whole,
    "p5_waste": p5_waste,
    "p6_found": p6_found,
    "p6_near": p6_near,
    "p7_pieces": p7_pieces,
    "p7_files": p7_files,
    "p7_whole": p7_whole,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def _spelled(name: str) -> str:
    """A field under any style of its name."""
    words = re.findall("[A-Z]?[a-z]+", name)
    styles = [name, name[0].upper() + name[1:], "_".join(w.lower() for w in words), name.upper()]
    return "coalesce(" + ", ".join(f"json_extract_string(payload, '$.{s}')" for s in styles) + ")"


_KEYS = ", ".join(f"regexp_replace(replace(lower(upper({_spelled(n)})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]|[{dictcopies.ACCENTS}]', '', 'g') AS k{i}" for i, n in enumerate(("sourceText", "blockKind", "sourceFilePath")))
_GROUPS = f"k AS (SELECT record_id, {_KEYS} FROM chunk_records), g AS (SELECT record_id, min(record_id) OVER w AS first FROM k WINDOW w AS (PARTITION BY k0, k1, k2))"


def _sql_leaks() -> str:
    """Every run of twelve words of every item, looked up among those of every page; pages also without the numbers of their lists."""
    no_marks = "regexp_replace(text, '\\]\\([^)\\s]*(\\s+\"[^\"\\n]*\")?\\)|\\]\\[[^\\]\\n]*\\]', '] ', 'g')"
    bare = "regexp_replace(t, '(?m)^[ \\t>]*[0-9]{1,9}[.)]([ \\t])', '\\1', 'g')"
    words = "regexp_extract_all(lower(regexp_replace(nfc_normalize(t), '\\p{Cf}', '', 'g')), '[\\p{L}\\p{N}\\p{Mn}\\p{Mc}]+')"
    runs = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) AS run"
    return f"""WITH d0 AS (SELECT doc_id, {no_marks} AS t FROM documents WHERE text IS NOT NULL), d1 AS (SELECT doc_id, t FROM d0 UNION ALL SELECT doc_id, {bare} FROM d0),
d AS (SELECT doc_id, {words} AS w FROM d1), i AS (SELECT item_id, {words} AS w FROM (SELECT item_id, {no_marks} AS t FROM eval_items WHERE text IS NOT NULL)),
dr AS (SELECT doc_id, {runs} FROM d WHERE len(w) >= 12), ir AS (SELECT DISTINCT item_id, {runs} FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir ON dr.run = ir.run"""


def oracle_sql() -> dict[str, str]:
    form = lookalike.canonical_sql("source_text")
    return {
        "p2_found": f"WITH c AS (SELECT DISTINCT chunk_id, source_text, {form} AS form FROM chunks WHERE source_text IS NOT NULL) SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM c a JOIN c b ON a.form = b.form AND a.source_text <> b.source_text AND a.chunk_id < b.chunk_id",
        "p2_canonical": f"SELECT DISTINCT chunk_id, sha256(source_text) AS text_hash, sha256({form}) AS canonical_hash FROM chunks",
        "p2_forms": f"WITH c AS (SELECT DISTINCT chunk_id, source_text, {form} AS form FROM chunks WHERE source_text IS NOT NULL AND chunk_id IS NOT NULL) SELECT sha256(form) AS canonical_hash, count(DISTINCT source_text) AS spellings, count(*) AS rows FROM c GROUP BY form",
        "p3_found": f"WITH {_GROUPS} SELECT first AS record_id_a, record_id AS record_id_b FROM g WHERE record_id > first",
        "p5_whole": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text IS NOT NULL",
        "p5_waste": "SELECT true AS possible, true AS tight",
        "p6_found": _sql_leaks(),
        "p7_whole": "SELECT doc_id, sha256(text) AS text_hash, true AS within, true AS overlaps FROM documents WHERE text IS NOT NULL",
        "p3_records": f"WITH {_GROUPS} SELECT first AS record_id, count(*) AS copies FROM g GROUP BY 1",
    }
