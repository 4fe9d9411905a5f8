"""Markdown to typed, encoded chunks, keeping each block's exact slice of the text. Pure Python, used inside Arrow batches.

Blocks: ATX and setext headings, paragraphs, nested lists and quotes, pipe tables, fenced and indented code, HTML blocks,
thematic breaks, link reference definitions. Inlines: code spans, emphasis, links and images (inline and reference),
angle autolinks, raw HTML, entities, line breaks, backslash escapes. What isn't understood stays literal or is skipped.

A chunk's ``start`` and ``stop`` are character offsets of its inline content in the text, so that a document is put
together again by replacing slices: nothing else in it can change.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|(?:\d{1,9}|[A-Za-z]|[ivxlcdm]+|[IVXLCDM]+)[.)])(?:( {1,4})(?! )|( )|$)")
_PLAIN_ITEM = re.compile(r"[-+*]|\d{1,9}[.)]")
# a letter that begins no item: nothing but a table's row or a paragraph may begin so
_PLAIN = re.compile(r"(?!(?:[A-Za-z]|[ivxlcdm]+|[IVXLCDM]+)[.)])[^\W\d_]")
_HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|!\[CDATA\[|(?:script|pre|style|textarea)(?=[\s>]|$)|/?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$))", re.I)
_HTML_ENDS = ((re.compile(r" {0,3}<!--"), "-->"), (re.compile(r" {0,3}<\?"), "?>"), (re.compile(r" {0,3}<!\[CDATA\["), "]]>"), (re.compile(r" {0,3}<![A-Z]"), ">"), (re.compile(r" {0,3}<(?:script|pre|style|textarea)", re.I), "</"))
_HTML_ALONE = re.compile(r" {0,3}</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>[ \t]*$")
_REFERENCE = re.compile(r" {0,3}\[([^\]\[]+)\]:[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+(\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*$")
_DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")

_CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?)>")
_RAW = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|!--.*?-->|\?.*?\?>|![A-Z][^>]*>|!\[CDATA\[.*?\]\]>)", re.S)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_INLINE_TARGET = re.compile(r"\(\s*(<[^<>\n]*>|[^\s()<]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_URL = re.compile(r"(?:https?://|ftp://|mailto:|www\.)[^\s<>]*[^\s<>?!.,:*_~'\")\]]")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]|[^\w\s]")
# a character and what follows it up to the next that may mean something; without links addresses mean nothing
_LITERAL = {
    True: re.compile(r"(?s:.)(?:[^\\\n`<&\[!*_~hfmw]++|(?<=\w)[hfmw]|(?!https?://|ftp://|mailto:|www\.)[hfmw])*+"),
    False: re.compile(r"(?s:.)[^\\\n`<&\[!*_~]*+"),
}


@dataclass
class Chunk:
    kind: str
    text: str
    start: int
    stop: int
    placeholders: dict[int, str] = field(default_factory=dict)
    links: dict[int, dict] = field(default_factory=dict)
    emphasis: dict[int, dict] = field(default_factory=dict)


@dataclass
class _Line:
    """What is left of a line inside its containers: text, and its offset in the document."""

    text: str
    at: int
    end: str  # the line break


def _lines(text: str) -> list[_Line]:
    found, at = [], 0
    for m in re.finditer(r"\r\n|\n|\r", text):
        found.append(_Line(text[at : m.start()], at, m.group()))
        at = m.end()
    if at < len(text):
        found.append(_Line(text[at:], at, ""))
    return found


def parse(text: str) -> list[Chunk]:
    """Chunks of a document in order."""
    lines = _lines(text[1:] if text.startswith("﻿") else text)
    if text.startswith("﻿"):
        for line in lines:
            line.at += 1
    references: dict[str, tuple[str, str | None]] = {}
    for line in lines:
        m = _REFERENCE.match(line.text) if "]:" in line.text else None
        if m:
            references.setdefault(_label(m[1]), (m[2].strip("<>"), m[3][1:-1] if m[3] else None))
    chunks: list[Chunk] = []
    _blocks(lines, "Paragraph", chunks, references, text)
    return chunks


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _indent(text: str) -> int:
    n = 0
    for c in text:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _starts_block(text: str) -> bool:
    """Whether a line ends a paragraph before it."""
    if _PLAIN.match(text):
        return False
    if not text.strip():
        return True
    item = _ITEM.match(text)
    starts_item = item and _PLAIN_ITEM.match(item[2]) and text[item.end() :].strip() and (not item[2][0].isdigit() or item[2][:-1] == "1")
    return bool(_FENCE.match(text) or _HEADING.match(text) or _BREAK.match(text) or _QUOTE.match(text) or starts_item or _HTML.match(text))


def _blocks(lines: list[_Line], kind: str, chunks: list[Chunk], references: dict, text: str) -> None:
    n = 0
    while n < len(lines):
        line = lines[n]
        bare = line.text
        if not bare.strip():
            n += 1
        elif "|" not in bare and _PLAIN.match(bare):
            n = _paragraph(lines, n, kind, chunks, references, text)
        elif _indent(bare) >= 4:
            while n < len(lines) and (not lines[n].text.strip() or _indent(lines[n].text) >= 4):
                n += 1
        elif m := _FENCE.match(bare):
            n = _after_fence(lines, n, m[1])
        elif m := _HEADING.match(bare):
            stop = len(re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", bare[m.end() :].rstrip())) + m.end()
            _leaf([_Line(bare[m.end() : stop].rstrip(), line.at + m.end(), "")], "Heading", chunks, references, text)
            n += 1
        elif _BREAK.match(bare):
            n += 1
        elif _QUOTE.match(bare):
            n = _quote(lines, n, chunks, references, text)
        elif (m := _ITEM.match(bare)) and (text_after := bare[m.end() :]) is not None and (_PLAIN_ITEM.match(m[2]) or text_after.strip()):
            n = _item(lines, n, m, chunks, references, text)
        elif _HTML.match(bare) or _HTML_ALONE.match(bare):
            n = _after_html(lines, n)
        elif _REFERENCE.match(bare):
            n += 1
        elif "|" in bare and n + 1 < len(lines) and _DELIMITER_ROW.match(lines[n + 1].text) and ("|" in lines[n + 1].text) and len(_cells(bare)) == len(_cells(lines[n + 1].text)):
            n = _table(lines, n, chunks, references, text)
        else:
            n = _paragraph(lines, n, kind, chunks, references, text)


def _after_fence(lines: list[_Line], n: int, mark: str) -> int:
    close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
    n += 1
    while n < len(lines) and not close.match(lines[n].text):
        n += 1
    return n + 1


def _after_html(lines: list[_Line], n: int) -> int:
    for opens, end in _HTML_ENDS:
        if opens.match(lines[n].text):
            while n < len(lines) and end not in lines[n].text:
                n += 1
            return n + 1
    while n < len(lines) and lines[n].text.strip():
        n += 1
    return n


def _quote(lines: list[_Line], n: int, chunks: list[Chunk], references: dict, text: str) -> int:
    inner = []
    while n < len(lines):
        line = lines[n]
        m = _QUOTE.match(line.text)
        if m:
            inner.append(_Line(line.text[m.end() :], line.at + m.end(), line.end))
        elif inner and inner[-1].text.strip() and not _starts_block(line.text):
            inner.append(line)  # a lazy continuation
        else:
            break
        n += 1
    _blocks(inner, "BlockQuote", chunks, references, text)
    return n


def _item(lines: list[_Line], n: int, m: re.Match, chunks: list[Chunk], references: dict, text: str) -> int:
    line = lines[n]
    width = m.end() if m[3] or m[4] else len(m[0]) + 1
    inner = [_Line(line.text[m.end() :], line.at + m.end(), line.end)]
    n += 1
    while n < len(lines):
        line = lines[n]
        if not line.text.strip():
            ahead = next((x for x in lines[n:] if x.text.strip()), None)
            if ahead is None or _indent(ahead.text) < width:
                break
            inner.append(_Line("", line.at, line.end))
        elif _indent(line.text) >= width:
            cut = len(line.text) - len(line.text.lstrip())
            cut = min(cut, width)
            inner.append(_Line(line.text[cut:], line.at + cut, line.end))
        elif inner[-1].text.strip() and not _starts_block(line.text) and not _ITEM.match(line.text):
            inner.append(line)
        else:
            break
        n += 1
    _blocks(inner, "ListItem", chunks, references, text)
    return n


def _cells(row: str) -> list[tuple[int, int]]:
    """Spans of a row's cells; pipes inside code spans or behind a backslash part nothing."""
    edges, at, code = [], 0, [m.span() for m in _CODE.finditer(row)]
    if "\\" not in row and not code:
        edges, at = [m.start() for m in re.finditer(r"\|", row)], len(row)
    while at < len(row):
        if row[at] == "\\":
            at += 2
            continue
        if row[at] == "|" and not any(a <= at < b for a, b in code):
            edges.append(at)
        at += 1
    if not edges:
        return [(0, len(row))]
    found = []
    if row[: edges[0]].strip():
        found.append((0, edges[0]))
    found += [(a + 1, b) for a, b in zip(edges, edges[1:])]
    if row[edges[-1] + 1 :].strip():
        found.append((edges[-1] + 1, len(row)))
    return found


def _table(lines: list[_Line], n: int, chunks: list[Chunk], references: dict, text: str) -> int:
    width = len(_cells(lines[n].text))
    delimiter = n + 1
    while n < len(lines) and lines[n].text.strip() and (n <= delimiter or not _starts_block(lines[n].text)):
        if n != delimiter:
            line = lines[n]
            for a, b in _cells(line.text)[:width]:
                cell = line.text[a:b]
                lead = len(cell) - len(cell.lstrip())
                _leaf([_Line(cell.strip(), line.at + a + lead, "")], "TableCell", chunks, references, text)
        n += 1
    return n


def _paragraph(lines: list[_Line], n: int, kind: str, chunks: list[Chunk], references: dict, text: str) -> int:
    taken = [lines[n]]
    n += 1
    while n < len(lines):
        bare = lines[n].text
        if _SETEXT.match(bare):
            kind = "Heading"
            n += 1
            break
        if _starts_block(bare):
            break
        taken.append(lines[n])
        n += 1
    first = taken[0]
    lead = len(first.text) - len(first.text.lstrip())
    taken[0] = _Line(first.text[lead:], first.at + lead, first.end)
    taken[-1] = _Line(taken[-1].text.rstrip(), taken[-1].at, "")
    _leaf(taken, kind, chunks, references, text)
    return n


def _leaf(lines: list[_Line], kind: str, chunks: list[Chunk], references: dict, text: str) -> None:
    stop = lines[-1].at + len(lines[-1].text)
    encoded = _Inline(lines, references, text)
    if encoded.text.strip():
        chunks.append(Chunk(kind, encoded.text, lines[0].at, stop, encoded.placeholders, encoded.links, encoded.emphasis))


class _Inline:
    """Inline content to encoded text and its three tables.

    The lines are joined by one character (a line break); what the document has between them (white space, container
    marks) is kept with the break's placeholder.
    """

    def __init__(self, lines: list[_Line], references: dict, text: str) -> None:
        self.references = references
        self.placeholders: dict[int, str] = {}
        self.links: dict[int, dict] = {}
        self.emphasis: dict[int, dict] = {}
        self.breaks: list[str] = []
        joined = []
        for n, line in enumerate(lines):
            bare = line.text.lstrip() if n else line.text
            if n + 1 < len(lines):
                kept = bare.rstrip(" \t")
                if kept.endswith("\\") and not kept.endswith("\\\\"):
                    kept = kept[:-1]
                begin = line.at + (len(line.text) - len(bare)) + len(kept)
                nxt = lines[n + 1]
                end = nxt.at + len(nxt.text) - len(nxt.text.lstrip())
                self.breaks.append(text[begin:end])
                bare = kept + "\n"
            joined.append(bare)
        self.seen_breaks = 0
        self.text = self._render(self._parse("".join(joined)))

    def _parse(self, s: str, links: bool = True) -> list:
        """Nodes: text, ('atom', kind, original), ('link', meta, nodes), ('em', delim, count, nodes); delimiter runs are matched last."""
        nodes: list = []
        at, literal = 0, []

        def flush() -> None:
            if literal:
                nodes.append("".join(literal))
                literal.clear()

        def atom(kind: str, original: str) -> None:
            flush()
            nodes.append(("atom", kind, original))

        while at < len(s):
            c = s[at]
            if c == "\\" and at + 1 < len(s) and _PUNCT.match(s[at + 1]) and s[at + 1].isascii():
                literal.append(s[at : at + 2])
                at += 2
            elif c == "\n":
                atom("BR", "\n")
                at += 1
            elif c == "`":
                m = _CODE.match(s, at)
                run = re.compile("`+").match(s, at)
                if m:
                    atom("CODE", m.group())
                    at = m.end()
                else:
                    literal.append(run.group())
                    at = run.end()
            elif c == "<" and (m := _AUTOLINK.match(s, at)):
                atom("AUTOLINK", m.group())
                at = m.end()
            elif c == "<" and (m := _RAW.match(s, at)):
                atom("HTML", m.group())
                at = m.end()
            elif c == "&" and (m := _ENTITY.match(s, at)):
                atom("HTML", m.group())
                at = m.end()
            elif c == "[" or (c == "!" and s[at + 1 : at + 2] == "["):
                link = self._link(s, at, links)
                if link:
                    flush()
                    nodes.append(link[0])
                    at = link[1]
                else:
                    literal.append(c)
                    at += 1
            elif c in "*_~":
                run = re.compile(re.escape(c) + "+").match(s, at)
                before, after = s[at - 1 : at] or " ", s[run.end() : run.end() + 1] or " "
                flush()
                nodes.append(_Run(c, len(run.group()), *_flanks(c, before, after)))
                at = run.end()
            elif links and c in "hfmw" and not (at and (s[at - 1].isalnum() or s[at - 1] in "/_")) and (m := _URL.match(s, at)):
                flush()
                nodes.append(("bare", m.group()))
                at = m.end()
            else:
                stop = _LITERAL[links].match(s, at).end()
                literal.append(s[at:stop])
                at = stop
        flush()
        return _match_runs(nodes)

    def _link(self, s: str, at: int, links: bool) -> tuple[tuple, int] | None:
        image = s[at] == "!"
        begin = at + 1 + image
        if not image and not links:
            return None
        end = _closing_bracket(s, begin)
        if end < 0:
            return None
        label = s[begin:end]
        m = _INLINE_TARGET.match(s, end + 1) if s[end + 1 : end + 2] == "(" else None
        if m:
            meta, stop = {"url": m[1], "title": m[2][1:-1] if m[2] else None, "is_image": image}, m.end()
        else:
            ref = re.compile(r"\[([^\]\[]*)\]").match(s, end + 1)
            name = _label(ref[1] or label) if ref else _label(label)
            if name not in self.references:
                return None
            url, title = self.references[name]
            meta, stop = {"url": url, "title": title, "is_image": image}, ref.end() if ref else end + 1
        return ("link", meta, self._parse(label, links=image and links)), stop

    def _render(self, nodes: list) -> str:
        out = []
        for node in nodes:
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, _Run):
                out.append(node.char * node.count)
            elif node[0] == "atom":
                original = node[2]
                if "\n" in original:
                    parts = original.split("\n")
                    original = parts[0]
                    for part in parts[1:]:
                        original += self.breaks[self.seen_breaks] + part
                        self.seen_breaks += 1
                self.placeholders[n := len(self.placeholders)] = original
                out.append(f"⟦{node[1]}{n}⟧")
            elif node[0] == "bare":
                # a bare address is sent as it stands, marked as a link of itself
                n = len(self.links)
                self.links[n] = {"url": node[1], "title": None, "is_image": False}
                out.append(f"<link{n}>{node[1]}</link{n}>")
            elif node[0] == "link":
                n = len(self.links)
                self.links[n] = node[1]
                out.append(f"<link{n}>{self._render(node[2])}</link{n}>")
            else:
                n = len(self.emphasis)
                self.emphasis[n] = {"delim": node[1], "count": node[2]}
                name = "strong" if node[2] >= 2 else "em"
                out.append(f"<{name}{n}>{self._render(node[3])}</{name}{n}>")
        return "".join(out)


@dataclass
class _Run:
    char: str
    count: int
    opens: bool
    closes: bool


def _flanks(char: str, before: str, after: str) -> tuple[bool, bool]:
    left = not after.isspace() and (not _PUNCT.match(after) or before.isspace() or bool(_PUNCT.match(before)))
    right = not before.isspace() and (not _PUNCT.match(before) or after.isspace() or bool(_PUNCT.match(after)))
    if char == "_":
        return left and (not right or bool(_PUNCT.match(before))), right and (not left or bool(_PUNCT.match(after)))
    return left, right


def _match_runs(nodes: list) -> list:
    """Pairs delimiter runs from the inside out."""
    n = 0
    while n < len(nodes):
        closer = nodes[n]
        if not (isinstance(closer, _Run) and closer.closes and closer.char != "~"):
            n += 1
            continue
        k = n - 1
        while k >= 0:
            opener = nodes[k]
            if isinstance(opener, _Run) and opener.opens and opener.char == closer.char and not ((opener.closes or closer.opens) and (opener.count + closer.count) % 3 == 0 and (opener.count % 3 or closer.count % 3)):
                break
            k -= 1
        if k < 0:
            n += 1
            continue
        opener = nodes[k]
        count = 2 if min(opener.count, closer.count) >= 2 else 1
        inner = [x for x in nodes[k + 1 : n]]
        span = ("em", closer.char, count, inner)
        left = [_Run(opener.char, opener.count - count, opener.opens, opener.closes)] if opener.count > count else []
        right = [_Run(closer.char, closer.count - count, closer.opens, closer.closes)] if closer.count > count else []
        nodes[k : n + 1] = [*left, span, *right]
        n = k + len(left) + 1
    return nodes


def _closing_bracket(s: str, at: int) -> int:
    depth = 0
    while at < len(s):
        c = s[at]
        if c == "\\":
            at += 2
            continue
        if c == "`" and (m := _CODE.match(s, at)):
            at = m.end()
            continue
        if c == "<" and (m := _AUTOLINK.match(s, at) or _RAW.match(s, at)):
            at = m.end()
            continue
        if c == "[":
            depth += 1
        elif c == "]":
            if not depth:
                return at
            depth -= 1
        at += 1
    return -1


def rebuild(text: str, pieces: list[tuple[int, int, str]]) -> str:
    """The document with the slices [start, stop) replaced; all other characters stay."""
    out, at = [], 0
    for start, stop, new in sorted(pieces):
        out.append(text[at:start])
        out.append(new)
        at = stop
    out.append(text[at:])
    return "".join(out)
