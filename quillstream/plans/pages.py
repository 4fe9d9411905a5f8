"""A page at a time: its chunks, the memory, batches, the translator, checks and the page again, in every language.

A page's texts are in one task from its body to its outputs, so that nothing is shuffled or written once a language but the
answers, which are written before anything reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillstream.functions import markdown, markers
from quillstream.operators import chunks as chunk_ops
from quillstream.operators import translate
from quillstream.plans.batching import chain

ANSWER = "ordinal int, source_text string, attempts array<string>, from_cache boolean, kept boolean, error string"
OUT = f"path string, source_hash string, target_lang string, markdown string, chunks int, repaired array<int>, untranslated array<int>, error string, answers array<struct<{ANSWER.replace(' ', ':').replace(',:', ',')}>>"

#: A page of more characters is translated a language after another, not in all at once.
LARGE = 1 << 20
#: Characters of outputs, and rows, after which they are handed on.
_CHARS, _ROWS = 4 << 20, 256


def with_memory(pages: DataFrame, remembered: DataFrame) -> DataFrame:
    """``pages`` (path, ...) with ``remembered``: what the memory has of each path, as one array. Rows of other paths fall away."""
    full = remembered.where("path is not null and target_lang is not null and content_hash is not null and translated_text is not null")
    known = full.groupBy("path").agg(F.collect_list(F.struct("target_lang", "content_hash", "translated_text")).alias("remembered"))
    return pages.join(known, "path", "left")


def tokens(text: str) -> int:
    """As ``text.token_estimate``."""
    return max(1, len(text.encode("utf-16-be")) // 8)


def _batches(wanted: tuple[int, ...], counts: list[int], budget: int) -> list[tuple[int, ...]]:
    sums = np.concatenate([[0], np.cumsum([counts[n] for n in wanted])])
    starts = chain(sums, 0, budget)
    return [wanted[a:b] for a, b in zip(starts, [*starts[1:], len(wanted)])]


#: The answers of a page in a language: texts, attempts, whether the memory had them, whether all markers are kept, errors.
_Own = tuple[list[str], list[list[str]], list[bool], list[bool], list[str | None]]


def _answers(answers: list[_Own], kind: pa.DataType) -> pa.Array:
    """Lists of answers as an array, column by column."""
    fields = kind.value_type
    columns: list[list] = [[n for own in answers for n in range(len(own[0]))], *([x for own in answers for x in own[k]] for k in range(len(fields) - 1))]
    offsets = np.concatenate([[0], np.cumsum([len(own[0]) for own in answers])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=list(fields))).cast(kind)


def _remembered(row: pa.Array) -> dict[str, dict[str, str]]:
    """Texts by language and hash; of several the greatest."""
    memory: dict[str, dict[str, str]] = {}
    if row.null_count:
        return memory
    for lang, key, text in zip(*(row.flatten().field(k).to_numpy(zero_copy_only=False).tolist() for k in range(3))):
        known = memory.setdefault(lang, {})
        if known.setdefault(key, text) < text:
            known[key] = text
    return memory


def settle(pages: DataFrame, langs: list[str], hints: dict[str, str], make: Callable[[], translate.Translator], parallel: int, budget: int, retry: translate.Retry = translate.Retry()) -> DataFrame:
    """``pages`` (path, body, source_hash, remembered) in all ``langs``: a row a page and language as ``OUT`` has it.

    Answers have each chunk's attempts (the remembered text, or what was answered, and repairs), whether the memory had it, whether
    the last attempt keeps all markers, and what was wrong. Chunks that the memory lacks and those whose remembered text lost
    markers are batched separately. Each task has at most ``parallel`` calls in flight. A page that can't be parsed is an error of its own.
    """
    arrow = to_arrow_schema(StructType.fromDDL(OUT))

    def page(path: str, body: str | None, memory: dict[str, dict[str, str]], translator: translate.Translator, each: Callable[[Callable, list], Iterator]) -> Iterator[tuple[dict, _Own]]:
        try:
            own = markdown.parse(body) if body is not None else []
        except Exception as fault:  # noqa: BLE001 - a document's fault is its own
            for lang in langs:
                yield {"path": path, "target_lang": lang, "markdown": None, "chunks": 0, "repaired": [], "untranslated": [], "error": chunk_ops.FAILED + str(fault)}, ([], [], [], [], [])
            return
        texts = [c.text for c in own]
        ids = [hashlib.sha256(f"{path}\0{n}".encode()).hexdigest() for n in range(len(own))]
        counts = [tokens(x) for x in texts]
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in texts] if memory else []
        marked = [n for n, x in enumerate(texts) if markers.marker_set(x)]
        step = len(langs) if len(body or "") <= LARGE else 1
        for at in range(0, len(langs), step):
            known, calls, parts = {}, [], {}
            for lang in langs[at : at + step]:
                hit = known[lang] = list(map(memory[lang].get, hashes)) if lang in memory else [None] * len(own)
                new = tuple(n for n, x in enumerate(hit) if x is None)
                broken = tuple(n for n in marked if hit[n] is not None and not markers.keeps(texts[n], hit[n]))
                for wanted in (new, broken):
                    if wanted and wanted not in parts:  # most often the same in all languages
                        parts[wanted] = _batches(wanted, counts, budget)
                    calls += [(lang, part) for part in parts[wanted]] if wanted else []

            def call(asked: tuple[str, tuple[int, ...]], known: dict = known) -> list[tuple]:
                lang, part = asked
                hit = known[lang]
                return translate.answers(translator, [(ids[n], texts[n], hit[n]) for n in part], lang, hints.get(lang) or "", retry)

            said = {lang: ([[x] for x in hit], [True] * len(own), [None] * len(own)) for lang, hit in known.items()}
            for (lang, part), found in zip(calls, each(call, calls), strict=True):
                attempts, kept, errors = said[lang]
                for n, x in zip(part, found, strict=True):
                    _, attempts[n], kept[n], errors[n] = x
            for lang, (attempts, kept, errors) in said.items():
                yield chunk_ops.put_together(path, lang, body, own, attempts, errors, kept), (texts, attempts, [x is not None for x in known[lang]], kept, errors)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translator, rows, answers, size = make(), [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[:-1]]
            return pa.RecordBatch.from_arrays([*columns, _answers(answers, arrow.field("answers").type)], schema=arrow)

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for part in parts:
                for n in range(part.num_rows):
                    path, body, source_hash = (part.column(k)[n].as_py() for k in range(3))
                    for out, own in page(path, body, _remembered(part.column(3).slice(n, 1)), translator, pool.map if translate.waits(translator) else map):
                        rows.append(out | {"source_hash": source_hash})
                        answers.append(own)
                        size += 3 * len(out["markdown"] or body or "")
                        if size > _CHARS or len(rows) >= _ROWS:
                            yield batch()
                            rows, answers, size = [], [], 0
            if rows:
                yield batch()

    return pages.select("path", "body", "source_hash", "remembered").mapInArrow(task, OUT)
