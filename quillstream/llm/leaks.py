"""Problem 6: passages of held-out items inside a corpus, by CGK embedding and bit-sampling LSH over word windows.

Texts become sequences of words (runs of letters, marks and digits, lower case; in scripts without spaces every character is
a word; link targets and other Markdown marks are none). The sought passage has ``min_words`` words, and so have the
windows, which begin at every word of items and documents alike. A window is embedded by the CGK random walk: at step j the
walk writes the word it stands on and moves on if bit j of that word's hash says so; in two steps a word (32 at most) it reads the window.
Windows at a small edit distance get outputs at a small Hamming distance. Each LSH table has a walk of its own and hashes a
random sample of its steps, the first always among them; windows that agree in any table are candidates. The number of
tables follows from the recall that is asked for, by trial of random passages with an edit at the worst place. The walks
of all windows are worked out at once, from the last step to the first, as one at a word is what one or two words on
are at the step before.

Every candidate is verified exactly: around it, ``min_words`` consecutive item words must occur within ``max_edits`` word
edits. Equal windows agree in every table, so that passages without an edit are never missed.

Items are sent to the workers, whose index of them answers all windows in place, as long as they have no more than ``BLOCK_CHARS``
characters. Beyond that the windows of items and documents meet by shuffle on their LSH keys; document windows whose key no
item has fall away before, by a bit map of bounded size.

Defined results: null and empty texts, and items or documents of fewer words than ``min_words`` less the edits, leak nothing;
repeated rows give one result row a pair of ids; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.skew import lookup_join
from quillstream.llm.common import SLICE_CHARS, checkpoint

MIN_WORDS = 12
#: Share of passages with ``max_edits`` edits, at the worst place, that the tables must find.
RECALL = 0.95
#: Sampled steps of a walk.
SAMPLED = 5
BLOCK_CHARS = 16_000_000
SEED = 77003

_TARGET = re.compile(r"\]\([^)\s]*(?:\s+\"[^\"\n]*\")?\)|\]\[[^\]\n]*\]")
_NUMBERED = re.compile(r"^[ \t>]*\d{1,9}[.)](?=[ \t])", re.M)
#: Words by which a match may be told from another at the same keys: those that verification may look at.
_BEFORE, _BEHIND = 16, 32
_MASK = (1 << 20) - 1
#: Items that a key's list holds at most, or about.
ITEMS_OF_KEY = 1000
#: Bits of the map of item keys that goes to all workers.
_MAP_BITS = 27
_NO_SPACES = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN", "BOPOMOFO")


def _lower() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code unit to its lower-case letter, mark or digit, 0 for all else; the invisible ones, which part no words; those that are a word each."""
    low, skip, alone = np.zeros(65536, np.uint16), np.zeros(65536, bool), np.zeros(65536, bool)
    for code in range(65536):
        if 0xD800 <= code < 0xE000:
            continue
        kind = unicodedata.category(chr(code))
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or code == 0x034F:
            skip[code] = True
        elif kind[0] in "LN" or kind in ("Mn", "Mc"):
            low[code] = ord(chr(code).lower()[0])
            alone[code] = kind == "Lo" and unicodedata.name(chr(code), "").startswith(_NO_SPACES)
    return low, skip, alone


_LOW, _SKIP, _ALONE = _lower()
_rng = np.random.default_rng(SEED)
_POWERS = _rng.integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
_FOLD, _FOLD32, _OTHER_FOLD32 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class Words:
    """Words of several texts, one after another: hash, first letter, letters and owner of each."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\x00".join(texts)
        if not joined.isascii():
            if not unicodedata.is_normalized("NFC", joined):
                joined = unicodedata.normalize("NFC", joined)
        codes = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        skip = _SKIP[codes]
        if skip.any():
            codes = codes[~skip]
        low = _LOW[codes]
        isword = low > 0
        before = np.concatenate([[False], isword[:-1]]) if len(isword) else isword
        alone = _ALONE[codes]
        begins = isword & ~before
        if alone.any():
            begins |= isword & (alone | np.concatenate([[False], alone[:-1]]))
        starts = np.flatnonzero(begins)
        ends_of_text = np.flatnonzero(codes == 0)
        letters = low[isword].astype(np.uint64)
        rank = np.cumsum(isword)
        self.first = np.concatenate([rank[starts] - 1, [len(letters)]]) if len(starts) else np.zeros(1, np.int64)
        length = np.diff(self.first)
        place = (np.arange(len(letters)) - np.repeat(self.first[:-1], length)) & 1023
        if len(starts):
            h = np.add.reduceat(letters * _POWERS[place], self.first[:-1])
            h ^= h >> np.uint64(29)
            h *= _FOLD
            self.hash = h ^ (h >> np.uint64(32))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.letters = letters
        self.owner = np.searchsorted(ends_of_text, starts)
        self.texts = len(texts)
        self.spans = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        # a zero behind each text, on which a walk stays
        self.line = np.zeros(len(starts) + len(texts), np.uint64)
        self.at = np.arange(len(starts)) + self.owner
        self.line[self.at] = self.hash

    def text(self, start: int, end: int) -> tuple:
        """The words themselves, for exact comparison."""
        a, b = self.first[start], self.first[end]
        return tuple(self.first[start : end + 1] - a), self.letters[a:b].tobytes()

    def keys(self, sample: np.ndarray, walk: np.uint32, fold: np.uint32 = _FOLD32) -> np.ndarray:
        """The LSH key of the window at each word in one table."""
        return embed(self.line, sample, walk, fold)[self.at]

    def around(self) -> np.ndarray:
        """A hash of the words near each word, its place among them known."""
        n = len(self.line)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, _FOLD)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, np.uint64(pow(int(_FOLD), -1, 1 << 64)))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.line * power[:n])])
        at = self.at
        lo, hi = np.maximum(at - _BEFORE, self.spans[self.owner] + self.owner), np.minimum(at + _BEHIND, self.spans[self.owner + 1] + self.owner)
        return ((sums[hi] - sums[lo]) * inverse[lo]) ^ ((at - lo).astype(np.uint64) << np.uint64(58)) ^ ((hi - at).astype(np.uint64) << np.uint64(52))


def embed(line: np.ndarray, sample: np.ndarray, walk: np.uint32, fold: np.uint32 = _FOLD32) -> np.ndarray:
    """Folded outputs of the CGK walk's sampled steps, from every place of ``line``. Bit j of a word's hash moves the walk on at step j.

    Half words and no branches: the whole of a slice stays in the processor's cache.
    """
    chosen = set(sample.tolist())
    letters = (line ^ (line >> np.uint64(32))).astype(np.uint32)
    bits = letters * walk
    bits ^= bits >> np.uint32(16)
    bits = bits.view(np.int32)
    behind, own, moved = np.zeros(len(line) + 1, np.uint32), np.empty(len(line), np.uint32), np.empty(len(line), np.int32)
    for j in range(max(chosen), -1, -1):
        np.left_shift(bits, np.int32(31 - j), out=moved)
        np.right_shift(moved, np.int32(31), out=moved)  # all ones where the walk moves on
        np.bitwise_xor(behind[1:], behind[:-1], out=own)
        np.bitwise_and(own, moved.view(np.uint32), out=own)
        np.bitwise_xor(behind[:-1], own, out=own)
        if j in chosen:
            own *= fold
            own += letters
            np.right_shift(own, np.uint32(15), out=moved.view(np.uint32))
            own ^= moved.view(np.uint32)
        behind[:-1] = own
    return behind[:-1]


def walks(tables: int, window: int) -> list[tuple[np.ndarray, np.uint32]]:
    """Sampled steps and walk of each table, drawn anew for each."""
    rng = np.random.default_rng(SEED + 1)
    steps = min(2 * window, 32)
    return [(np.concatenate([[0], 1 + np.sort(rng.choice(steps - 1, min(SAMPLED, steps) - 1, replace=False))]), np.uint32(rng.integers(1, 2**32)) | np.uint32(1)) for _ in range(tables)]


@lru_cache(maxsize=16)
def tables_for(recall: float, min_words: int, max_edits: int, trials: int = 150, most: int = 64) -> int:
    """Tables that find this share of passages of ``min_words`` words with an edit, wherever it is; each further edit takes as many again."""
    if not max_edits:
        return 1
    rng = np.random.default_rng(SEED + 2)
    draw = lambda k: rng.integers(1, 2**63, (trials, k), dtype=np.uint64)
    zero, tables = np.zeros((trials, 1), np.uint64), walks(most, min_words)
    needed = 1
    for kind, shift in (("changed", 0), ("added", 1), ("lost", -1)):
        for place in range(min_words):
            item = draw(min_words)
            new = draw(1) if kind != "lost" else draw(0)
            edited = np.concatenate([item[:, :place], new, item[:, place + (kind != "added") :], draw(2 * min_words), zero], axis=1)
            ours, theirs = np.concatenate([item, zero], axis=1), edited
            left, right = np.arange(place), np.arange(place + (kind != "added"), min_words)
            missed = np.ones(trials, bool)
            for n, (sample, walk) in enumerate(tables, 1):
                a, b = (embed(x.ravel(), sample, walk).reshape(x.shape) for x in (ours, theirs))
                missed &= ~((a[:, left] == b[:, left]).any(axis=1) | (a[:, right] == b[:, right + shift]).any(axis=1))
                if missed.mean() <= 1 - recall:
                    break
            needed = max(needed, n)
    return min(most, needed * max_edits)


class ItemIndex:
    """Windows of items, by LSH key."""

    def __init__(self, items: list[tuple[int, str]], tables: int, window: int = MIN_WORDS) -> None:
        self.ids = [i for i, _ in items]
        self.words = Words([clean(t).replace("\x00", " ") for _, t in items])
        self.spans = self.words.spans
        around = self.words.around()
        self.tables = []
        for sample, walk in walks(tables, window):
            key = self.words.keys(sample, walk)
            # an item that repeats itself: of windows with the same words around them one will do
            _, one = np.unique(np.column_stack([key.astype(np.uint64), around, self.words.owner.astype(np.uint64)]), axis=0, return_index=True) if len(key) else (None, np.zeros(0, np.int64))
            order = one[np.argsort(key[one], kind="stable")]
            bitmap = np.zeros(_MASK + 1, bool)
            bitmap[key & np.uint32(_MASK)] = True
            self.tables.append((sample, walk, key[order], order, bitmap))

    def candidates(self, words: Words, most: int = 1 << 21) -> Iterator[np.ndarray]:
        """Pairs of window starts (document, item) that agree in a table, one a row, about ``most`` at a time."""
        around = words.around()
        found, size, width = [], 0, len(self.words.hash) + 1
        for sample, walk, sorted_keys, where, bitmap in self.tables:
            key = words.keys(sample, walk)
            maybe = np.flatnonzero(bitmap[key & np.uint32(_MASK)])
            lo, hi = np.searchsorted(sorted_keys, key[maybe], "left"), np.searchsorted(sorted_keys, key[maybe], "right")
            met = np.flatnonzero(hi > lo)
            maybe, lo, hi = maybe[met], lo[met], hi[met]
            if len(maybe) > 1:  # the same of a document that repeats itself
                _, one = np.unique(np.column_stack([key[maybe].astype(np.uint64), around[maybe], words.owner[maybe].astype(np.uint64)]), axis=0, return_index=True)
                maybe, lo, hi = maybe[one], lo[one], hi[one]
            count = hi - lo
            part = np.cumsum(count) // most
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                n = count[own]
                at = np.repeat(lo[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append(np.repeat(maybe[own], n) * width + where[at])
                size += len(at)
                if size >= most:
                    yield np.column_stack(np.divmod(np.unique(np.concatenate(found)), width))
                    found, size = [], 0
        if found:  # most pairs agree in several tables
            yield np.column_stack(np.divmod(np.unique(np.concatenate(found)), width))


def clean(text: str) -> str:
    return _TARGET.sub("] ", text) if "](" in text or "][" in text else text


def edits_within(item: list, text: list, most: int) -> bool:
    """Whether the item's words occur somewhere in the text's within ``most`` word edits."""
    row = [0] * (len(text) + 1)
    for n, word in enumerate(item, 1):
        last, row = row, [n]
        for k, other in enumerate(text, 1):
            row.append(min(last[k - 1] + (word != other), last[k] + 1, row[-1] + 1))
        if min(row) > most:
            return False
    return min(row) <= most


def _equal_words(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, room: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words are equal from positions i and j on (step 1) or back (-1), up to ``room`` and ``most``."""
    count = np.zeros(len(i), np.int64)
    going = np.flatnonzero(room > 0)
    for n in range(most):
        going = going[n < room[going]]
        going = going[a[i[going] + n * step] == b[j[going] + n * step]]
        if not len(going):
            break
        count[going] += 1
    return count


def _reach(index: ItemIndex, words: Words, pairs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Item words around each pair of equal words that occur without an edit, and with one at most. ``most`` bounds each run."""
    a, b = words.hash, index.words.hash
    i, j = pairs[:, 0], pairs[:, 1]
    text, item = words.owner[i], index.words.owner[j]
    lo_a, hi_a, lo_b, hi_b = words.spans[text], words.spans[text + 1], index.spans[item], index.spans[item + 1]
    ahead = _equal_words(a, i, b, j, np.minimum(hi_a - i, hi_b - j), 1, most)
    back = _equal_words(a, i - 1, b, j - 1, np.minimum(i - lo_a, j - lo_b), -1, most)
    plain = ahead + back
    edited = plain.copy()
    for changed, missing in ((1, 1), (1, 0), (0, 1)):  # words passed over in the text and in the item: changed, added, lost
        x, y = i + ahead + changed, j + ahead + missing
        after = _equal_words(a, x, b, y, np.minimum(hi_a - x, hi_b - y), 1, most)
        edited = np.maximum(edited, plain + after + np.where(y <= hi_b, missing, 0))
        x, y = i - back - 1 - changed, j - back - 1 - missing
        before = _equal_words(a, x, b, y, np.minimum(x + 1 - lo_a, y + 1 - lo_b), -1, most)
        edited = np.maximum(edited, plain + before + np.where(y + 1 >= lo_b, missing, 0))
    return plain, edited


Found = dict[tuple[int, int], tuple[int, int]]


def _better(found: Found, key: tuple[int, int], edits: int, words: int) -> None:
    old = found.get(key)
    if old is None or (edits, -words) < (old[0], -old[1]):
        found[key] = (edits, words)


def _verified(index: ItemIndex, words: Words, pairs: np.ndarray, min_words: int, max_edits: int) -> Found:
    """Least edits and, at these, most item words of each (text, item) that has ``min_words`` within ``max_edits`` edits."""
    found: Found = {}
    pairs = pairs[words.hash[pairs[:, 0]] == index.words.hash[pairs[:, 1]]]
    if not len(pairs):
        return found
    plain, edited = _reach(index, words, pairs, min_words)
    good = np.flatnonzero((plain if not max_edits else edited) >= min_words)
    if len(good):
        near = pairs[good]
        plain_all, edited_all = _reach(index, words, near, 1 << 30)
        for (i, j), run, with_one in zip(near.tolist(), plain_all.tolist(), edited_all.tolist(), strict=True):
            key = (int(words.owner[i]), int(index.words.owner[j]))
            if run >= min_words:
                _better(found, key, 0, run)
            else:
                _better(found, key, 1, with_one)
    if max_edits > 1:
        for i, j in np.delete(pairs, good, axis=0).tolist():
            text, item = int(words.owner[i]), int(index.words.owner[j])
            if (text, item) in found:
                continue
            lo_a, hi_a, lo_b, hi_b = words.spans[text], words.spans[text + 1], index.spans[item], index.spans[item + 1]
            for q in range(max(lo_b, j - min_words + 1), min(j, hi_b - min_words) + 1):
                first = i - (j - q)
                some = words.hash[max(lo_a, first - max_edits) : max(lo_a, min(hi_a, first + min_words + max_edits))].tolist()
                least = next((e for e in range(2, max_edits + 1) if edits_within(index.words.hash[q : q + min_words].tolist(), some, e)), None)
                if least is not None:
                    _better(found, (text, item), least, min_words)
    return found


def views_of(texts: list[str]) -> tuple[Words, list[int]]:
    """Words of the texts and the text of each view: a numbered list is read with and without its numbers."""
    views, owner = [], []
    for n, text in enumerate(texts):
        text = clean(text).replace("\x00", " ")
        views.append(text)
        owner.append(n)
        bare = _NUMBERED.sub("", text)
        if len(bare) != len(text):
            views.append(bare)
            owner.append(n)
    return Words(views), owner


def scan(index: ItemIndex, texts: list[str], min_words: int = MIN_WORDS, max_edits: int = 0) -> Found:
    """(number of the text, number of the item) to edits and words in common."""
    words, owner = views_of(texts)
    found: Found = {}
    if len(words.hash):
        for pairs in index.candidates(words):
            for (view, item), (edits, run) in _verified(index, words, pairs, min_words, max_edits).items():
                _better(found, (owner[view], item), edits, run)
    return found


OUT = "doc_id long, item_id long, edits int, words int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("words", pa.int32())])


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of about a slice's characters."""
    at = 0
    while at < len(texts):
        some, first, size = [], at, 0
        while at < len(texts) and size < SLICE_CHARS:
            some.append(texts[at].as_py())
            size += len(some[-1])
            at += 1
        yield first, some


def _in_place(frame: DataFrame, items: list[tuple[int, str]], min_words: int, max_edits: int, tables: int) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(ItemIndex(items, tables, min_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, some in _slices(batch.column(1)):
                found = sorted((keys[first + n], index.ids[i], edits, run) for (n, i), (edits, run) in scan(index, some, min_words, max_edits).items())
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], _SCHEMA.types[c]) for c in range(4)], schema=_SCHEMA)

    return frame.mapInArrow(run, OUT)


def _by_shuffle(frame: DataFrame, held: DataFrame, min_words: int, max_edits: int, tables: int) -> DataFrame:
    """Windows of documents and items meet on their LSH keys; pairs of texts with a common key are verified whole."""
    spark, tuned = frame.sparkSession, walks(tables, min_words)
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64())])

    def keyed(known: object | None) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = known.value if known is not None else None
            for batch in batches:
                ids = np.array(batch.column(0).to_pylist(), np.int64)
                for first, some in _slices(batch.column(1)):
                    words, owner = views_of(some)
                    rows = first + np.array(owner, np.int64)[words.owner]
                    for n, (sample, walk) in enumerate(tuned):
                        high, low = (words.keys(sample, walk, fold).astype(np.uint64) for fold in (_FOLD32, _OTHER_FOLD32))
                        key = ((high << np.uint64(32) | low) ^ np.uint64(n)).view(np.int64)
                        own = rows
                        if bits is not None:
                            place = key & ((1 << _MAP_BITS) - 1)
                            there = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                            key, own = key[there], rows[there]
                        pairs = np.unique(np.column_stack([own, key]), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(pairs[:, 1])], schema=schema)

        return run

    item_keys = checkpoint(held.mapInArrow(keyed(None), "id long, key long").distinct())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (_MAP_BITS - 3), np.uint8)
        for batch in batches:
            place = np.asarray(batch.column(0)) & ((1 << _MAP_BITS) - 1)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": [bits.tobytes()]})

    # one map of 16 MB a part, whatever the items: a part of the tasks' maps meet in a second step
    every = np.zeros(1 << (_MAP_BITS - 3), np.uint8)
    for row in item_keys.select("key").coalesce(16).mapInArrow(mapped, "bits binary").toLocalIterator():
        every |= np.frombuffer(row.bits, np.uint8)
    doc_keys = frame.mapInArrow(keyed(spark.sparkContext.broadcast(every)), "id long, key long").withColumnRenamed("id", "doc_id")
    # items of a key go in blocks, and documents to each of its blocks; neither a key of very many documents nor one of very many
    # items is a hot task or a long list
    weight = doc_keys.groupBy("key").agg(F.count("*").alias("_n"))
    blocks = item_keys.groupBy("key").agg(F.ceil(F.count("*") / ITEMS_OF_KEY).cast("int").alias("blocks")).join(weight, "key")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    of_block = lookup_join(item_keys, blocks.withColumn("w", F.col("blocks").cast("long") * ITEMS_OF_KEY), ["key"], "w").groupBy("key", block.alias("block")).agg(F.collect_set("id").alias("items"), F.first("_n").alias("_n"))
    asked = lookup_join(doc_keys, blocks, ["key"], "_n").select("doc_id", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = lookup_join(asked, of_block, ["key", "block"], "_n").select("doc_id", F.explode("items").alias("item_id")).distinct()
    met = checkpoint(met)
    with_item = lookup_join(met, held.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")).join(met.groupBy("item_id").agg(F.count("*").alias("_n")), "item_id"), ["item_id"], "_n")
    rows = with_item.join(frame, "doc_id").select("doc_id", "item_id", "text", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, item, text, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for edits, run in scan(ItemIndex([(item, passage)], tables, min_words), [text], min_words, max_edits).values():
                    found.append((doc, item, edits, run))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], _SCHEMA.types[c]) for c in range(4)], schema=_SCHEMA)

    return rows.mapInArrow(verify, OUT)


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, max_edits: int = 1, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, edits, words: every document that holds a passage of an item; the fewest edits that its passages need and, at
    these, the item words of the longest one. Without edits none is missed, with them ``recall`` of all."""
    if not 0 <= max_edits < min_words <= 32:
        raise ValueError("0 <= max_edits < min_words <= 32")
    frame = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    held = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct()
    tables = tables_for(recall, min_words, max_edits)
    chars = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    found = _in_place(frame, [tuple(r) for r in held.collect()], min_words, max_edits, tables) if chars <= BLOCK_CHARS else _by_shuffle(frame, held, min_words, max_edits, tables)
    best = F.min(F.struct("edits", (-F.col("words")).alias("w")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.edits").alias("edits"), (-F.col("b.w")).alias("words"))
