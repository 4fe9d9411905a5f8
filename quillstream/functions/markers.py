"""The marker language of encoded text: scanning, comparing, splicing. Pure Python, used inside Arrow batches.

text := (literal | placeholder | span)*; placeholder := '⟦' letters digits '⟧'; span := '<' name digits '>' text '</' name digits '>';
name is em, strong or link. Any other '<' is literal. A placeholder counts by its number only; a span by name and number.
A span's opening digits are read as a number, its closing digits as written, so that <em00> is closed by </em0>.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

NAMES = ("em", "strong", "link")
_MARK = re.compile(rf"⟦(?:([^\W\d_]+)([0-9]+)⟧)?|<(/?)({'|'.join(NAMES)})([0-9]+)>")


class MarkerError(ValueError):
    """Text that is not in the marker language."""


class Token(NamedTuple):
    """text, placeholder, open or close; ``index`` and ``name`` as far as the kind has them."""

    kind: str
    index: int = -1
    depth: int = 0
    text: str = ""


def _may_hold(text: str) -> bool:
    return "⟦" in text or "<" in text


def _marks(text: str) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text before the first mark; for each mark placeholder, open or close, its number, its name, and the text behind it."""
    parts, stack = _MARK.split(text), []
    found = []
    for n in range(1, len(parts), 6):
        letters, number, slash, name, digits, after = parts[n : n + 6]
        if name is None:
            if number is None:
                raise MarkerError(f"Malformed placeholder token starting at position {_position(text, n)}.")
            found.append(("placeholder", int(number), letters, after))
        elif slash:
            if not stack or stack[-1] != name + digits:
                raise MarkerError(f"Unmatched closing tag '{name}{digits}' at position {_position(text, n)}.")
            stack.pop()
            found.append(("close", int(digits), name, after))
        else:
            index = int(digits)
            stack.append(f"{name}{index}")
            found.append(("open", index, name, after))
    if stack:
        raise MarkerError(f"Missing closing tag '{stack[-1]}'.")
    return parts[0], found


def _position(text: str, part: int) -> int:
    return next(islice(_MARK.finditer(text), part // 6, None)).start()


# an answer is read when it comes and when it is put in
_marks_of_short = lru_cache(2048)(_marks)


def _read(text: str) -> tuple[str, list[tuple[str, int, str, str]]]:
    return _marks_of_short(text) if len(text) <= 2000 else _marks(text)


def scan(text: str) -> list[Token]:
    """Tokens in order, spans as open and close. Raises MarkerError for one of: unmatched or missing close, malformed placeholder."""
    if not _may_hold(text):
        return [Token("text", text=text)] if text else []
    first, marks = _read(text)
    found, depth = [Token("text", text=first)] if first else [], 0
    for kind, index, name, after in marks:
        depth -= kind == "close"
        found.append(Token(kind, index, depth, name))
        depth += kind == "open"
        if after:
            found.append(Token("text", depth=depth, text=after))
    return found


def marker_set(text: str | None) -> frozenset[tuple[str, int]]:
    """What must survive a translation; empty where the text can't be scanned."""
    if not text or not _may_hold(text):
        return frozenset()
    return _set_of_short(text) if len(text) <= 2000 else _set(text)


def _set(text: str) -> frozenset[tuple[str, int]]:
    try:
        return frozenset(("placeholder" if kind == "placeholder" else name, index) for kind, index, name, _ in _read(text)[1] if kind != "close")
    except MarkerError:
        return frozenset()


# a source is compared with every language's answer
_set_of_short = lru_cache(8192)(_set)


def missing(source: str | None, translated: str | None) -> list[str]:
    """Readable names of the source's markers that the translation lacks. Extra ones are no fault."""
    own = marker_set(source)
    lost = sorted(own - marker_set(translated)) if own else []
    return [f"the placeholder at index {i}" if name == "placeholder" else f"the <{name}{i}>...</{name}{i}> tag pair" for name, i in lost]


def keeps(source: str, translated: str) -> bool:
    """Whether nothing is ``missing``."""
    own = marker_set(source)
    return not own or own <= marker_set(translated)


def splice(text: str, placeholders: dict[int, str], links: dict[int, dict], emphasis: dict[int, dict]) -> str:
    """Markdown of an encoded text. Raises MarkerError for what can't be scanned and for numbers that aren't in the tables."""
    if not _may_hold(text):
        return text
    first, marks = _read(text)
    out, used = [first], set()
    for kind, index, name, after in marks:
        if kind == "placeholder":
            if index not in placeholders:
                raise MarkerError(f"Unknown placeholder index {index}.")
            if index in used:
                raise MarkerError(f"Placeholder index {index} used twice.")
            used.add(index)
            out.append(placeholders[index])
        elif name == "link":
            if index not in links:
                raise MarkerError(f"Unknown link index {index}.")
            link = links[index]
            if kind == "open":
                out.append("![" if link["is_image"] else "[")
            else:
                title = f' "{link["title"]}"' if link["title"] is not None else ""
                out.append(f"]({link['url'] or ''}{title})")
        else:
            if index not in emphasis:
                raise MarkerError(f"Unknown emphasis index {index}.")
            mark = emphasis[index]
            out.append(mark["delim"] * mark["count"])
        out.append(after)
    return "".join(out)


HEALED = ("ok", "repaired", "unrecoverable")


def heal(source: str, attempts: Iterator[str | None] | list[str | None], repairs: int = 2) -> tuple[str, str, int]:
    """(text, status, repairs used): the first of at most 1 + ``repairs`` attempts that keeps all markers, else the source."""
    count = -1
    for attempt in attempts:
        count += 1
        if attempt is not None and not missing(source, attempt):
            return attempt, "ok" if count == 0 else "repaired", count
        if count == repairs:
            break
    return source, "unrecoverable", max(0, count)


def splice_or_source(text: str, source: str, tables: tuple[dict, dict, dict], fallback: Callable[[], str]) -> tuple[str, bool]:
    """The spliced text; where that fails, the original slice and True."""
    try:
        return splice(text, *tables), False
    except MarkerError:
        return fallback(), True
