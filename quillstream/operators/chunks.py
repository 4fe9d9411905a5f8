"""Markdown documents to chunks, and chunks with translations back to documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillstream.functions import markdown, markers
from quillstream.functions.text import sha256_hex
from quillstream.model import CHUNKS


def extract(frame: DataFrame, path: str, body: str) -> DataFrame:
    """A row a chunk of every document, in order; null bodies have none. Parsing is the one step that needs Python."""
    schema = StructType.fromDDL(CHUNKS)
    raw = StructType([f for f in schema.fields if f.name not in ("chunk_id", "content_hash")])
    arrow = to_arrow_schema(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, c in enumerate(markdown.parse(text.as_py())):
                    found.append({"path": key, "ordinal": n, "source_text": c.text, "block_kind": c.kind, "start": c.start, "stop": c.stop, "placeholders": list(c.placeholders.items()), "links": list(c.links.items()), "emphasis": list(c.emphasis.items())})
                if len(found) > 5000:
                    yield pa.RecordBatch.from_pylist(found, arrow)
                    found = []
            yield pa.RecordBatch.from_pylist(found, arrow)

    rows = frame.select(F.col(path).alias("path"), F.col(body).alias("body")).where("body is not null").mapInArrow(run, raw)
    return rows.withColumn("chunk_id", chunk_id(F.col("path"), F.col("ordinal"))).withColumn("content_hash", sha256_hex(F.col("source_text"))).select(*schema.names)


def chunk_id(path, ordinal):
    """Always the same for the same place, so that a task run again gives the same ids."""
    return F.sha2(F.concat(path, F.lit("\0"), ordinal.cast("string")), 256)


# A fixed value: how the error of a document begins.
FAILED = "unexpected reconstruction failure - "
_OUT = "path string, target_lang string, markdown string, chunks int, repaired array<int>, untranslated array<int>, error string"


def _nothing(path: str, lang: str) -> dict:
    return {"path": path, "target_lang": lang, "markdown": None, "chunks": 0, "repaired": [], "untranslated": [], "error": None}


def put_together(path: str, lang: str, body: str | None, own: list[markdown.Chunk], attempts: list[list[str] | None], errors: list[str | None], kept: list[bool] | None = None) -> dict:
    """A document in a language, as a row of ``rebuild``, from its parsed chunks and the attempts and error of each.

    ``kept``: whether the last of a chunk's attempts, and none before it, has all markers, if that is known."""
    out = _nothing(path, lang)
    try:
        if body is None:
            return out
        if not all(attempts):
            silent = [n for n, tries in enumerate(attempts) if not tries]
            told = next((errors[n] for n in silent if errors[n]), "no answer")
            return out | {"error": f"not translated - {len(silent)} of {len(own)} chunks without an answer: {told}"}
        new = []
        for n, (c, tries) in enumerate(zip(own, attempts, strict=True)):
            if kept is None:
                text, status, _ = markers.heal(c.text, tries)
            else:
                text, status = tries[-1], "unrecoverable" if not kept[n] else "ok" if len(tries) == 1 else "repaired"
            if status == "unrecoverable":
                out["untranslated"].append(n)
                continue
            failed = False
            if "⟦" in text or "<" in text:
                text, failed = markers.splice_or_source(text, c.text, (c.placeholders, c.links, c.emphasis), lambda c=c: body[c.start : c.stop])
            if failed:
                out["untranslated"].append(n)
            elif status == "repaired":
                out["repaired"].append(n)
            new.append((c.start, c.stop, text))
        out["markdown"], out["chunks"] = markdown.rebuild(body, new), len(own)
    except Exception as fault:  # noqa: BLE001 - a document's fault is its own
        out["error"] = FAILED + str(fault)
    return out


def rebuild(frame: DataFrame, path: str, body: str, translated: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """path, target_lang, markdown, chunks, repaired, untranslated, error: each document once a language of ``langs``, or of
    those in ``translated`` (path, ordinal, target_lang, attempts: array of texts, in order; error, if there are such).

    A document without chunks comes out as it is, one without a body has no text. One with a chunk that has no attempt in a
    language is an error there and has no text: half a translation would pass for a whole one.
    Each chunk takes the first of up to three attempts that keeps its markers, else its source. Only the chunks'
    encoded spans are replaced. A fault in one pair of document and language is that row's error, and no other's.
    The attempts of one document in one language come together, as its text must be one value.
    """
    problem = F.col("error") if "error" in translated.columns else F.lit(None).cast("string").alias("error")
    grouped = translated.groupBy("path", "target_lang").agg(F.sort_array(F.collect_list(F.struct("ordinal", "attempts", problem))).alias("pieces"))
    if langs is None:
        langs = [r.target_lang for r in translated.select("target_lang").distinct().collect()]
    # the bodies come in last, so that they are not shuffled once a language
    pairs = frame.select(F.col(path).alias("path")).distinct().withColumn("target_lang", F.explode(F.lit(langs).cast("array<string>")))
    rows = pairs.join(grouped, ["path", "target_lang"], "left").join(frame.select(F.col(path).alias("path"), F.col(body).alias("body")), "path").select("path", "target_lang", "body", "pieces")
    arrow = to_arrow_schema(StructType.fromDDL(_OUT))

    def one(row: dict, parsed: dict) -> dict:
        try:
            if row["body"] not in parsed:  # a document's languages follow one another
                parsed.clear()
                parsed[row["body"]] = markdown.parse(row["body"]) if row["body"] is not None else []
        except Exception as fault:  # noqa: BLE001 - a document's fault is its own
            return _nothing(row["path"], row["target_lang"]) | {"error": FAILED + str(fault)}
        own = parsed[row["body"]]
        pieces = {p["ordinal"]: (p["attempts"], p["error"]) for p in row["pieces"] or []}
        unknown = sorted(set(pieces) - set(range(len(own))))
        if unknown:
            return _nothing(row["path"], row["target_lang"]) | {"error": f"{FAILED}translation for unknown chunk {unknown[0]}"}
        attempts, errors = ([pieces.get(n, (None, None))[k] for n in range(len(own))] for k in (0, 1))
        return put_together(row["path"], row["target_lang"], row["body"], own, attempts, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([one(r, parsed) for r in batch.slice(at, 64).to_pylist()], arrow)

    return rows.mapInArrow(run, _OUT)


#: Chunks that one value may hold when a document is put together from texts alone.
PART = 10_000


def concatenated(frame: DataFrame, keys: list[str], ordinal: str, text: str, part: int = PART) -> DataFrame:
    """Texts in order, parted by blank lines, a row a document and part of ``part`` places; rows without text are left out."""
    rows = frame.where(F.col(text).isNotNull()).withColumn("part_no", F.floor(F.col(ordinal) / part).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys, "part_no").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("markdown"), F.count("*").alias("chunks"))
