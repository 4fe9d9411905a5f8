"""Translators and the steps around them: prompts, batches of calls, retries, repairs.

A translator is anything with ``translate(items, lang, hint, problem) -> reply text`` for a list of (id, text), whose reply
is JSON as ``model.REPLY`` has it. The built-in one needs no network. Calls are side effects and tasks may run again: what a
translator said is written (checkpointed) before anything reads it.
"""

from __future__ import annotations

import json
import random
import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import partial
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import markers

# What a prompt says, by line.
SYSTEM = (
    "You are a professional technical documentation translator. Translate every given chunk into the language with code '{lang}'.",
    "Each chunk's text may contain special markers that you MUST preserve EXACTLY, character-for-character, in their original relative position:",
    "- Placeholder tokens such as ⟦CODE0⟧, ⟦AUTOLINK1⟧, ⟦HTML2⟧, ⟦BR3⟧ - copy them verbatim; never translate, reorder, or alter their digits.",
    "- Paired tags such as <em0>...</em0>, <strong0>...</strong0>, <link0>...</link0> - translate ONLY the text between the tags, and keep the tag name and number exactly as given.",
    "Do not translate the placeholder or tag markers themselves under any circumstances.",
    "Return exactly one translation per chunk id given, and no other chunk ids.",
)
USER = 'Translate the following chunks. Each line is "[chunkId]: text".'


class CallError(RuntimeError):
    """A failed call: the status, or None where no answer came; what the server asked to wait."""

    def __init__(self, message: str, status: int | None = None, retry_after: str | None = None) -> None:
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


class Translator(Protocol):
    def translate(self, items: list[tuple[str, str]], lang: str, hint: str, problem: str | None) -> str: ...


class FakeTranslator:
    """Puts the language in brackets before each text."""

    waits = False

    def translate(self, items: list[tuple[str, str]], lang: str, hint: str = "", problem: str | None = None) -> str:
        return json.dumps({"translations": [{"chunkId": i, "translatedText": f"[{lang}] {t}"} for i, t in items]}, ensure_ascii=False)


PROVIDERS: dict[str, Callable[[Mapping[str, str]], Translator]] = {"fake": lambda env: FakeTranslator()}
#: The setting that holds a provider's key; the built-in one needs none.
KEYS: dict[str, str] = {}


def register(name: str, make: Callable[[Mapping[str, str]], Translator], key: str | None = None) -> None:
    """Makes a provider selectable; ``key`` is the setting that must be there for it."""
    PROVIDERS[name] = make
    if key:
        KEYS[name] = key


def select(env: Mapping[str, str], provider: str = "auto") -> Translator:
    """The named provider; of ``auto`` the only one whose key is set. None and several are errors."""
    name = provider.strip().lower() or "auto"
    if name != "auto":
        if name not in PROVIDERS:
            raise ValueError(f"unknown provider '{provider}'")
        if name in KEYS and not env.get(KEYS[name], "").strip():
            raise ValueError(f"provider '{name}' needs {KEYS[name]}")
        return PROVIDERS[name](env)
    found = [n for n, k in KEYS.items() if env.get(k, "").strip()]
    if len(found) != 1:
        raise ValueError("no provider is configured" if not found else f"several providers are configured ({', '.join(found)}); name one")
    return PROVIDERS[found[0]](env)


def waits(translator: Translator) -> bool:
    """Whether calls spend their time waiting, so that several are held in flight. Only a class that says of itself that its calls
    don't gets them one after another: threads would but take the interpreter from each other."""
    return vars(type(translator)).get("waits", True)


def transient(status: int | None) -> bool:
    return status is None or status == 429 or status >= 500


def wait_seconds(attempt: int, retry_after: str | None, base: float = 3.0, now: datetime | None = None, jitter: Callable[[], float] = random.random) -> float:
    """What the server asked for, in seconds or as a date; else exponential from ``base`` with up to as much again at random."""
    if retry_after:
        if retry_after.strip().isdigit():
            return float(retry_after)
        try:
            return max(0.0, (parsedate_to_datetime(retry_after) - (now or datetime.now(UTC))).total_seconds())
        except (TypeError, ValueError):
            pass
    return base * 2**attempt * (0.5 + jitter())


def with_transport_retry(call: Callable[[], str], retries: int = 5, base: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(retries + 1):
        try:
            return call()
        except CallError as fault:
            if not transient(fault.status) or attempt == retries:
                raise
            sleep(wait_seconds(attempt, fault.retry_after, base))
    raise AssertionError


def id_problem(requested: list[str], returned: list[str]) -> str | None:
    """What is wrong with the returned ids, or None."""
    if requested == returned and len(set(returned)) == len(returned):
        return None
    asked, got = dict.fromkeys(requested), Counter(returned)
    missing = [i for i in asked if i not in got]
    extra = [i for i in got if i not in asked]
    twice = [i for i, n in got.items() if n > 1]
    parts = [f"{n}: {', '.join(x)}" for n, x in (("missing", missing), ("unexpected", extra), ("duplicated", twice)) if x]
    return f"Chunk id mismatch in provider response ({'; '.join(parts)})." if parts else None


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    transport: int = 5
    base: float = 3.0


def translate_batch(translator: Translator, items: list[tuple[str, str]], lang: str, hint: str, retry: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple[dict[str, str], str | None]:
    """Texts by id; or nothing and the last problem, which each further attempt is told."""
    problem = None
    for _ in range(retry.attempts):
        try:
            reply = json.loads(with_transport_retry(lambda p=problem: translator.translate(items, lang, hint, p), retry.transport, retry.base, sleep))
            found = [(x["chunkId"], x["translatedText"]) for x in reply["translations"]]
            problem = id_problem([i for i, _ in items], [i for i, _ in found])
            if problem is None:
                return dict(found), None
        except (CallError, ValueError, KeyError, TypeError) as fault:
            problem = str(fault) or type(fault).__name__
    return {}, problem


def repair(translator: Translator, item: tuple[str, str], bad: str, lang: str, hint: str, retry: Retry, sleep: Callable[[float], None] = time.sleep) -> str:
    """A second try at one text, told what it lost; the bad text again if the call fails. Of several items the own, else the first."""
    lost = ", ".join(markers.missing(item[1], bad))
    try:
        reply = json.loads(with_transport_retry(lambda: translator.translate([item], lang, hint, f"The previous answer lost {lost}: {bad}"), retry.transport, retry.base, sleep))
        found = reply["translations"]
        return next((x for x in found if x["chunkId"] == item[0]), found[0])["translatedText"]
    except (CallError, ValueError, KeyError, TypeError, IndexError):
        return bad


def prompt(items: list[tuple[str, str]], lang: str, hint: str, problem: str | None) -> tuple[str, str]:
    """System and user prompt of one call; a second try is told what was wrong with the first."""
    system = "\n".join([SYSTEM[0].replace("{lang}", lang), *SYSTEM[1:]]) + "\n" + (hint + "\n" if hint else "")
    wanted = 'Answer with JSON: {"translations": [{"chunkId": ..., "translatedText": ...}]}\n' + (f"The last answer was refused: {problem}\n" if problem else "")
    return system + wanted, USER + "\n\n" + "".join(f"[{i}]: {t}\n" for i, t in items)


def prompts(batched: DataFrame, keys: list[str], lang: str, ordinal: str, chunk: str, text: str, hint: str) -> DataFrame:
    """keys, system_prompt, user_prompt of every batch, which its token budget bounds."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(chunk).alias("c"), F.col(text).alias("t"))))
    line = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("["), x["c"], F.lit("]: "), x["t"], F.lit("\n"))), "")
    rows = batched.groupBy(*keys).agg(line.alias("lines"), F.first(F.coalesce(F.col(hint), F.lit(""))).alias("hint"))
    head, rest = SYSTEM[0].split("{lang}")
    system = F.concat(F.lit(head), F.col(lang), F.lit("\n".join([rest, *SYSTEM[1:]]) + "\n"), F.when(F.col("hint") != "", F.concat("hint", F.lit("\n"))).otherwise(""))
    return rows.select(*keys, system.alias("system_prompt"), F.concat(F.lit(USER + "\n\n"), "lines").alias("user_prompt"))


def answers(translator: Translator, items: list[tuple[str, str, str | None]], lang: str, hint: str, retry: Retry = Retry(), repairs: int = 2) -> list[tuple[str, list[str], bool, str | None]]:
    """(chunk_id, attempts, kept, error) of each of a batch's items (chunk_id, source_text, known), in order; see ``run``."""
    known = {i: k for i, _, k in items if k is not None}
    new = [(i, t) for i, t, _ in items if i not in known]
    found, problem = translate_batch(translator, new, lang, hint, retry) if new else ({}, None)
    rows = []
    for i, text, _ in items:
        first = known.get(i, found.get(i))
        tries = [] if first is None else [first]
        kept = first is not None and ("⟦" not in text and "<" not in text or markers.keeps(text, first))
        while tries and len(tries) <= repairs and not kept:
            tries.append(repair(translator, (i, text), tries[-1], lang, hint, retry))
            kept = markers.keeps(text, tries[-1])
        rows.append((i, tries, kept, None if tries else problem))
    return rows


def run(batches: DataFrame, make: Callable[[], Translator], parallel: int = 4, retry: Retry = Retry(), repairs: int = 2) -> DataFrame:
    """``batches`` (batch keys..., target_lang, hint, items: array of (chunk_id, source_text, known)) translated: chunk_id, target_lang,
    attempts (the first answer and up to ``repairs`` more while markers are missing), kept (whether the last has them all), error.

    An item whose ``known`` text isn't null is not asked for but repaired from there. Tasks are as many as the batches'
    partitions; each has at most ``parallel`` calls in flight, so that a translator must stand calls from several threads. A batch
    that fails for good gives rows with an error and no attempts, and ends nothing else.
    """
    out = "chunk_id string, target_lang string, attempts array<string>, kept boolean, error string"
    schema = pa.schema([("chunk_id", pa.string()), ("target_lang", pa.string()), ("attempts", pa.list_(pa.string())), ("kept", pa.bool_()), ("error", pa.string())])

    def call(translator: Translator, row: dict) -> pa.RecordBatch:
        found = answers(translator, [(x["chunk_id"], x["source_text"], x.get("known")) for x in row["items"]], row["target_lang"], row["hint"] or "", retry, repairs)
        rows = [{"chunk_id": i, "target_lang": row["target_lang"], "attempts": tries, "kept": kept, "error": error} for i, tries, kept, error in found]
        return pa.RecordBatch.from_pylist(rows, schema)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translator = make()
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for part in parts:
                for at in range(0, part.num_rows, max(1, parallel)):
                    yield from pool.map(partial(call, translator), part.slice(at, max(1, parallel)).to_pylist())

    return batches.select("target_lang", "hint", "items").mapInArrow(task, out)


def fake(lang: Column, source: Column) -> Column:
    """What the built-in translator says, as a column."""
    return F.concat(F.lit("["), lang, F.lit("] "), source)
