"""Problem 1: language of documents and of their blocks, by hyperdimensional n-gram profiles.

Every letter of any script has a random +1/-1 vector, drawn from a hash of the letter. A trigram's vector binds (multiplies) its
letters' vectors, each permuted (rolled inside its range) by its place. A text is the bundle (sum) of its trigrams' vectors,
a language prototype the bundle of labelled training text; both are compared by cosine. As bundling is
linear, a text's dot product with a prototype is the sum over its trigrams of the trigram's own dot product
with that prototype. That small table is computed once from the vectors, so no document vector has to be
materialised; the document's norm is common to all languages and cancels in the comparison. A trigram that training
has not seen counts as that of its letters' scripts, which have vectors too; in scripts of very many letters both count.

A block is in another language than its page from a confidence on that is worked out on labelled texts kept out of training:
cut into pieces of the sizes that blocks have, no more than ``FALSE_FOREIGN`` of them may count as foreign to their own language.

Defined results: a null, empty or letterless text has language NULL and confidence 0; ties go to the language
first in the alphabet; a text of any length is read whole, in slices; extra columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import SLICE_CHARS, sample_rows

DIMENSIONS = 32768
#: Added to an n-gram's share, so that one seen by chance doesn't decide.
RARE = 4e-6
TRAIN_ROWS = 2500
SEED = 20240607
#: Trigrams seen less often in training are left out.
LEAST_SEEN = 3
#: Share of blocks in a page's own language that may count as foreign. Every so-many-th training text is kept out to see.
FALSE_FOREIGN, HELD_OUT = 1e-4, 5

_FENCE = ("```", "~~~")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: Not prose: code spans, link and image targets, autolinks, HTML tags and markers.
_NOT_PROSE = re.compile("`[^`\n\x01]*`|\\]\\([^)\n\x01]*\\)|<[^>\n\x01]{1,200}>|⟦[^⟧\n\x01]{1,40}⟧|https?://[^\\s\x01]+")
_CODE = re.compile(r"\s*([A-Za-z]{2})(?:[-_][A-Za-z0-9]{2,8})*\s*$")


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Code unit to its lower-case letter, 0 for what is none (signs that make up letters, as vowels do, are some); and to its script."""
    letter, script = np.zeros(65536, np.uint64), np.zeros(65536, np.uint64)
    scripts: dict[str, int] = {}
    for code in range(65536):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or not (char.isalpha() or (unicodedata.category(char)[0] == "M" and not 0x300 <= code <= 0x36F)):
            continue
        low = "i" if char == "İ" else char.lower()[0]
        letter[code] = ord(low)
        script[code] = scripts.setdefault(unicodedata.name(low, "OTHER").split(" ")[0].split("-")[0], len(scripts) + 1)
    return letter, script


_LETTER, _SCRIPT = _alphabet()
#: Letters of scripts with so many that most of a text's trigrams are rare: there the scripts' trigram counts as well.
_MANY = np.array([unicodedata.name(chr(c), "").startswith(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ETHIOPIC", "YI ")) for c in range(65536)])
_OF_SCRIPTS = np.uint64(1 << 60)
_TWO, _ONE = np.uint64(32), np.uint64(16)
_MIX, _OTHER_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Dimensions that are worked on at a time, inside which vectors are rolled.
_RANGE = 512


def language_code(label: str | None) -> str | None:
    """Two lower-case letters, or None where the label holds no language code. Region, case and outer spaces don't matter."""
    m = _CODE.match(label) if label else None
    return m.group(1).lower() if m else None


def blocks(text: str) -> Iterator[tuple[int, str | None]]:
    """Numbered blocks of a page; a blank line ends one. The text is None where the block is (part of) fenced code."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    number, fence = 0, ""
    for block in _BLANK.split(text):
        if not block or block.isspace():
            continue
        number += 1
        if not fence and _FENCE[0] not in block and _FENCE[1] not in block:
            yield number, block
            continue
        prose = []
        for line in block.split("\n"):
            mark = line.lstrip(" >")[:3]
            if fence:
                fence = "" if mark == fence else fence
            elif mark in _FENCE:
                fence = mark
            else:
                prose.append(line)
        yield number, "\n".join(prose) if any(p.strip() for p in prose) else None


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code units of a text and the trigrams of letters and of scripts that start at each of them. Pieces are separated by \x01."""
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    a, b = _LETTER[codes], _SCRIPT[codes]
    return codes, (a[:-2] << _TWO) | (a[1:-1] << _ONE) | a[2:], _OF_SCRIPTS | (b[:-2] << _TWO) | (b[1:-1] << _ONE) | b[2:]


class Lookup:
    """Place of a trigram in a list of known ones, from 1; 0 if it isn't known."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.concatenate([[np.uint64(0xFFFFFFFFFFFFFFFF)], known])
        self.tables = []
        left = np.arange(1, len(self.known))
        for mix, bits in ((_MIX, 21), (_OTHER_MIX, 16), (_MIX ^ _OTHER_MIX, 16)):
            shift = np.uint64(64 - bits)
            slots = np.zeros(1 << bits, np.int32)
            at = (self.known[left] * mix) >> shift
            slots[at[::-1]] = left[::-1]
            self.tables.append((mix, shift, slots))
            left = left[slots[at] != left]  # those whose slot another one took
        self.rest = {int(self.known[n]): n for n in left.tolist()}

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        mix, shift, slots = self.tables[0]
        found = slots[(ids * mix) >> shift]
        missing = np.flatnonzero(self.known[found] != ids)
        for mix, shift, slots in self.tables[1:]:
            own = ids[missing]
            found[missing] = place = slots[(own * mix) >> shift]
            missing = missing[self.known[place] != own]
        found[missing] = 0
        if self.rest:
            for n in missing[np.isin(ids[missing], np.array(list(self.rest), np.uint64))].tolist():
                found[n] = self.rest[int(ids[n])]
        return found


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-1.702 * np.minimum(z, 30)))


@dataclass
class LanguageModel:
    languages: list[str]
    #: Known trigrams, and their dot products with each language's centred unit prototype.
    known: np.ndarray
    scores: np.ndarray
    #: Spread of one trigram's score difference; scale of the confidence.
    spread: float
    #: Confidence over the page's main language from which a block counts as being in another one.
    certain: float = 0.999

    def __post_init__(self) -> None:
        self.lookup = Lookup(self.known)
        self.compact = np.vstack([np.zeros((1, len(self.languages)), np.float32), self.scores.astype(np.float32)])

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "known": self.known, "scores": self.scores.astype(np.float32), "spread": self.spread, "certain": self.certain}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def places(self, ids: np.ndarray, of_scripts: np.ndarray) -> np.ndarray:
        found = self.lookup(ids)
        unseen = np.flatnonzero(found == 0)
        found[unseen] = self.lookup(of_scripts[unseen])
        return found

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Dot products with the prototypes and letters of each text. Linear, so that long texts are summed in slices."""
        total, letters = np.zeros((len(texts), len(self.languages)), np.float32), np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            codes, ids, of_scripts = trigrams(_NOT_PROSE.sub(" ", "\x01" + "\x01".join(pieces) + "\x01 "))
            ends = np.flatnonzero(codes == 1)
            starts, np_owners = ends[:-1], np.array(owners)
            if len(starts) != len(owners):
                raise ValueError("pieces out of step")
            rows = self.compact[self.places(ids, of_scripts)]
            many = _MANY[codes]
            both = np.flatnonzero(many[:-2] | many[1:-1] | many[2:])
            both = both[self.lookup(ids[both]) > 0]
            rows[both] += self.compact[self.lookup(of_scripts[both])]
            sums = np.add.reduceat(rows, starts, axis=0, dtype=np.float32)
            count = np.add.reduceat((_LETTER[codes] > 0), starts, dtype=np.int64)
            np.add.at(total, np_owners, sums)
            np.add.at(letters, np_owners, count)

        for i, text in enumerate(texts):
            if "\x01" in text:
                text = text.replace("\x01", " ")
            for at in range(0, len(text), SLICE_CHARS) or [0]:
                piece = text[at : at + SLICE_CHARS]
                pieces.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= SLICE_CHARS:
                    flush()
                    pieces, owners, size = [], [], 0
        if pieces:
            flush()
        return total, letters

    def decide(self, total: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its confidence: the logistic of the margin over the runner-up in units of its own spread."""
        if total.shape[1] == 1:
            return np.zeros(len(total), int), np.where(letters > 0, 1.0, 0.0)
        best = total.argmax(axis=1)
        ordered = np.sort(total, axis=1)
        z = (ordered[:, -1] - ordered[:, -2]) / (self.spread * np.sqrt(np.maximum(letters, 1)))
        return best, np.where(letters > 0, _logistic(z), 0.0)


def letter_vectors(symbols: np.ndarray, first: int, count: int) -> np.ndarray:
    """Dimensions ``first`` to ``first + count`` of each symbol's +1/-1 vector: the bits of hashes of symbol and place."""
    x = symbols.astype(np.uint64)[:, None] * _MIX + (np.arange(first // 64, (first + count) // 64, dtype=np.uint64) + np.uint64(SEED)) * _OTHER_MIX
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three symbols of each trigram; scripts are told from letters."""
    flag, low = (ids & _OF_SCRIPTS) >> np.uint64(30), np.uint64(0xFFFF)
    return tuple(((ids >> np.uint64(s)) & low) | flag for s in (32, 16, 0))


def _dots(ids: np.ndarray, weights: np.ndarray, dimensions: int) -> np.ndarray:
    """Dot products of trigrams' unit vectors with centred unit prototypes (bundles of the same vectors by ``weights``).

    Worked out by ranges of dimensions, so that the vectors of all trigrams are never held at once; norms and centring
    follow from the prototypes' own dot products.
    """
    symbols, which = np.unique(np.concatenate(_symbols(ids)), return_inverse=True)
    a, b, c = which.reshape(3, -1)
    dots, gram = np.zeros((len(ids), len(weights))), np.zeros((len(weights), len(weights)))
    for at in range(0, dimensions, _RANGE):
        letters = letter_vectors(symbols, at, _RANGE)
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        parts = [slice(n, n + 8192) for n in range(0, len(ids), 8192)]
        vectors = [first[a[p]] * second[b[p]] * letters[c[p]] for p in parts]
        bundle = sum((weights[:, p] @ v.astype(np.float32) for p, v in zip(parts, vectors, strict=True)), np.zeros((len(weights), _RANGE), np.float32))
        for p, v in zip(parts, vectors, strict=True):
            dots[p] += v.astype(np.float32) @ bundle.T
        gram += bundle @ bundle.T
    norms = np.sqrt(np.maximum(np.diag(gram), 1e-12))
    unit, gram = dots / norms, gram / np.outer(norms, norms)
    if len(weights) == 1:
        return unit / np.sqrt(dimensions)
    centre = np.eye(len(weights)) - 1.0 / len(weights)
    size = np.sqrt(np.maximum(np.diag(centre @ gram @ centre), 1e-12))
    return unit @ centre / size / np.sqrt(dimensions)


def _counts(places: np.ndarray, cells: int, languages: int, label: np.ndarray) -> np.ndarray:
    return np.bincount(label * cells + places, minlength=languages * cells).reshape(languages, cells)


def fit(rows: list[tuple[str, str]], dimensions: int = DIMENSIONS, rounds: int = 2) -> LanguageModel:
    """Prototypes of labelled texts. Labels may be wrong now and then and pages mixed, so each further round bundles only the blocks that the last one agrees with."""
    texts, labels = [], []
    for label, text in rows:
        for _, block in blocks(text):
            if block:
                texts.append(block)
                labels.append(label)
    names = sorted(set(labels))
    if not names:
        return LanguageModel(["und"], np.zeros(0, np.uint64), np.zeros((0, 1), np.float32), 1.0)
    label_ids = np.array([names.index(x) for x in labels])
    codes, ids, of_scripts = trigrams(_NOT_PROSE.sub(" ", "\x01" + "\x01".join(t.replace("\x01", " ") for t in texts) + "\x01 "))
    owner = np.cumsum(codes[: len(ids)] == 1) - 1
    # a trigram of two or more non-letters says nothing
    letters = (_LETTER[codes] > 0).astype(np.int8)
    telling = (letters[:-2] + letters[1:-1] + letters[2:] >= 2) & (owner < len(texts))
    owner = owner[telling]
    streams = []
    for stream in (ids[telling], of_scripts[telling]):
        seen, place, times = np.unique(stream, return_inverse=True, return_counts=True)
        often = times >= LEAST_SEEN
        streams.append((seen[often], np.where(often, np.cumsum(often) - 1, -1)[place]))
    known = np.concatenate([s for s, _ in streams])
    keep = np.ones(len(texts), bool)
    for left in range(rounds, 0, -1):
        weights = []
        for seen, place in streams:
            own = keep[owner] & (place >= 0)
            counts = _counts(place[own], len(seen), len(names), label_ids[owner[own]])
            share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            # bundled by how much more common a trigram is than in the average language
            weights.append(np.log((share + RARE) / (share.mean(axis=0) + RARE)))
        dots = _dots(known, np.concatenate(weights, axis=1).astype(np.float32), dimensions)
        spread = float(np.std(dots[: len(streams[0][0])])) if len(streams[0][0]) else 1.0
        model = LanguageModel(names, known, dots, spread or 1.0)
        if left > 1:
            total, size = model.score(texts)
            keep = (total.argmax(axis=1) == label_ids) & (size >= 12)
    return model


#: Words of the pieces by which the threshold is found.
_PIECES = (1, 2, 3, 5, 8, 13, 21)


def pieces_of(model: LanguageModel, rows: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Words, language and text of pieces of all sizes, from blocks whose label the model confirms with enough letters to be sure."""
    own = [(model.languages.index(label), block) for label, text in rows if label in model.languages for _, block in blocks(text) if block]
    if not own:
        return []
    total, letters = model.score([b for _, b in own])
    sure = [x for x, best, n in zip(own, total.argmax(axis=1), letters, strict=True) if best == x[0] and n >= 60]
    found = []
    for lang, block in sure:
        bare = _NOT_PROSE.sub(" ", block)
        words = bare.split() if " " in bare.strip() else [bare[i : i + 4] for i in range(0, len(bare), 4)]
        at = 0
        for n in _PIECES:
            if at + n <= len(words):
                found.append((n, lang, " ".join(words[at : at + n])))
                at += n
    return found


def calibrated(model: LanguageModel, rows: list[tuple[str, str]], rate: float = FALSE_FOREIGN) -> LanguageModel:
    """Sets the confidence above which no more than ``rate`` of a page's own blocks count as foreign: that of pieces, weighted so that
    their sizes come as often as those of blocks do."""
    pieces = pieces_of(model, rows)
    if len(pieces) < 200 or len(model.languages) < 2:
        return model
    total, letters = model.score([t for _, _, t in pieces])
    size, lang = np.array([n for n, _, _ in pieces]), np.array([x for _, x, _ in pieces])
    natural = [len(b.split()) if " " in b.strip() else len(b) // 4 for _, text in rows for _, b in blocks(text) if b]
    share = np.bincount(np.searchsorted(_PIECES, np.maximum(natural, 1), "right") - 1, minlength=len(_PIECES)) / max(1, len(natural))
    kind = np.searchsorted(_PIECES, size)
    weight = share[kind] / np.maximum(np.bincount(kind, minlength=len(_PIECES)), 1)[kind]
    at = np.arange(len(pieces))
    own = total[at, lang]
    total[at, lang] = -np.inf
    margin = (total.max(axis=1) - own) / (model.spread * np.sqrt(np.maximum(letters, 1)))
    order = np.argsort(-margin)
    above = np.searchsorted(np.cumsum(weight[order]), rate, "right")
    model.certain = float(_logistic(np.float64(max(0.0, margin[order[min(above, len(order) - 1)]]) + 1e-6)))
    return model


def train(spark: SparkSession, sources: list[tuple[DataFrame, str, str, str]], bound: int = TRAIN_ROWS) -> LanguageModel:
    """Fits on at most ``bound`` labelled rows of each source (frame, id, label, text), a part of which sets the threshold."""
    rows: list[tuple[str, str]] = []
    for frame, key, label, text in sources:
        labelled = frame.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
        rows += [(language_code(r.l), r.t) for r in sample_rows(labelled, "k", bound, "l").orderBy("k").select("l", "t").toLocalIterator()]
    rows = [r for r in rows if r[0]]
    held = rows[::HELD_OUT]
    return calibrated(fit([r for n, r in enumerate(rows) if n % HELD_OUT]), held)


OUT = "row_id long, block_no int, lang string, confidence double, letters long, main_lang string, label string"


def detect(frame: DataFrame, key: str, text: str, model: LanguageModel, only_foreign: bool = False, label: str | None = None) -> DataFrame:
    """Language of every row (block_no 0) and of its blocks (from 1): row_id, block_no, lang, confidence, letters, main_lang, and the row's label as received.

    The main language is the one with most letters; its confidence is the letter-weighted mean of its blocks' times its share.
    ``only_foreign``: of the blocks, only those in another language than the main one.
    """
    shared = frame.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("row_id", pa.int64()), ("block_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64()), ("main_lang", pa.string()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            keys, texts, labels = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            start = 0
            while start < len(keys):
                prose: list[str] = []
                number: list[int] = []
                firsts: list[int] = []
                own: list[int] = []
                size, first_row = 0, start
                while start < len(keys) and size < SLICE_CHARS:
                    firsts.append(len(prose))
                    own.append(keys[start])
                    for n, block in blocks(texts[start].as_py() or ""):
                        if block:
                            prose.append(block)
                            number.append(n)
                            size += len(block)
                    start += 1
                yield pa.RecordBatch.from_pydict(_judge(m, names, own, labels[first_row:start], firsts, number, prose, only_foreign), schema)

    return frame.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None).cast("string")).alias("label")).mapInArrow(run, OUT)


def _judge(m: LanguageModel, names: np.ndarray, own: list[int], labels: list[str | None], firsts: list[int], number: list[int], prose: list[str], only_foreign: bool) -> dict:
    keys, rows = np.array(own, np.int64), len(own)
    owner = np.repeat(np.arange(rows), np.diff([*firsts, len(prose)]))
    total, letters = m.score(prose)
    best, sure = m.decide(total, letters)
    by = np.zeros((rows, len(names)))
    np.add.at(by, (owner, best), letters)
    main = by.argmax(axis=1)
    sums = by.sum(axis=1)
    known = sums > 0
    weight = np.zeros(rows)
    # a short block says little of itself: it is in the page's language unless it clearly isn't
    scale = m.spread * np.sqrt(np.maximum(letters, 1))
    at = np.arange(len(best))
    over = _logistic((total[at, best] - total[at, main[owner]]) / scale)
    stays = (best != main[owner]) & (over < m.certain)
    best, sure = np.where(stays, main[owner], best), np.where(stays, 1 - over, sure)
    at_main = best == main[owner]
    np.add.at(weight, owner[at_main], (letters * sure)[at_main])
    doc_sure = np.where(known, weight / np.maximum(sums, 1), 0.0)
    main_name = np.where(known, names[main], None)
    shown = (letters > 0) & ~(at_main & only_foreign)
    return {
        "row_id": np.concatenate([keys, keys[owner[shown]]]),
        "block_no": np.concatenate([np.zeros(rows, np.int32), np.array(number, np.int32)[shown]]),
        "lang": [*main_name, *names[best[shown]]],
        "confidence": np.concatenate([doc_sure, sure[shown]]),
        "letters": np.concatenate([sums.astype(np.int64), letters[shown]]),
        "main_lang": [*main_name, *main_name[owner[shown]]],
        "label": [*labels, *np.array([*labels, None], object)[:-1][owner[shown]]],
    }
