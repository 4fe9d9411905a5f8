"""Problem 7: texts over a token limit as ordered pieces within it, cut at natural boundaries, with an overlap.

Every text is read in byte ranges. A range carries a halo of its neighbours' bytes; the cut between two ranges is the last
line break (failing that, the last end of a word) before their nominal border, which both find alike. A range yields its
boundary table: length, tokens and kind of each of its lines. Stitching joins the tables of a text: a line that two
ranges share becomes one again, fences are counted through, lengths and tokens become prefix sums. Pieces are chosen on
the sums and cut out by offset. So the pieces do not depend on the ranges' size.

A text up to ``WHOLE_BYTES`` has all its ranges in one task. A larger one, in a column or a file, has them in many: lengths and
fences of the ranges are summed up, which gives each its offset in characters and the fence it begins in; behind every
multiple of ``STRETCH_BYTES`` an anchor is set, where a piece ends in any case, by a rule that needs no more than the halo;
each stretch between two anchors is read by its offsets and its pieces are chosen by the same code; their numbers are summed
up, and the pieces are read and put out by offset. Small texts have anchors at the same places.

A piece ends at the last block boundary (blank line outside fenced code) in its upper half; failing that at
a line, a sentence, a pretoken. The next piece begins before that end by the longest run of whole pretokens of at most
``overlap`` tokens. All cuts are between pretokens, where token counts add up exactly; only a pretoken of more tokens than the
overlap (or a quarter of the limit) is cut inside, by characters, and such pieces are counted again.

Defined results: null texts have no piece, an empty text has one empty piece; a text within the limit is one piece; pieces
without their overlaps, joined in order, are the text; repeated ids are split row by row and must be unique for texts over
``WHOLE_BYTES``; bytes that aren't UTF-8 (files only) come out as replacement characters. Only a run of more than the halo
without any end of a word in it is cut at the ranges' own borders.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from quillstream.llm import tokens
from quillstream.llm.common import checkpoint
from quillstream.sources.storage import file_system

LIMIT, OVERLAP = 512, 64
RANGE_BYTES, HALO_BYTES = 1 << 16, 1 << 14
#: A larger text is read by several tasks.
WHOLE_BYTES = 1 << 23
#: Bytes between two anchors, about.
STRETCH_BYTES = 1 << 19
#: Bytes that a task reads of a file, about.
TASK_BYTES = 1 << 24

_BLANK = re.compile(r"\s*\n[ \t\r]*\n")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”»」』）)\]*_`]*$")
_HARD = (3, 2, 1)  # block, line, line inside a fence
#: Kinds of lines in a boundary table.
BLANK_BEFORE, FENCE = 1, 2


class Splitter:
    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP, path: str = tokens.VOCABULARY, stretch: int = STRETCH_BYTES) -> None:
        if not 0 <= overlap <= limit // 2 or limit < 8:
            raise ValueError("0 <= overlap <= limit / 2 and limit >= 8")
        import regex

        self.limit, self.overlap, self.counter, self.grid = limit, overlap, tokens.counter(path), stretch
        self.pretokens = regex.compile(tokens.PATTERN).findall
        self.word_ends = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})").finditer
        #: A pretoken of more tokens is cut into chunks of characters; a character has at most four bytes and so tokens.
        self.most = max(1, min(limit // 4, overlap or limit))
        self.chunk = max(1, min(limit // 4, overlap or limit) // 4)

    def line(self, text: str) -> tuple[list[int], list[int], bool]:
        """Offsets and token sums at the pretokens of a line; whether one was cut inside."""
        offsets, sums, inside = [0], [0], False
        for p in self.pretokens(text):
            n = self.counter.unit(p)
            parts = [p] if n <= self.most or len(p) == 1 else [p[i : i + self.chunk] for i in range(0, len(p), self.chunk)]
            inside |= len(parts) > 1
            for part in parts:
                offsets.append(offsets[-1] + len(part))
                sums.append(sums[-1] + (n if len(parts) == 1 else self.counter.unit(part)))
        return offsets, sums, inside

    def detect(self, text: str, count: bool = True) -> tuple[list[int], list[int], list[int]]:
        """The boundary table of a range: length, tokens (unless they don't ``count``) and kind of each line."""
        lengths, counts, kinds, unit = [], [], [], self.counter.unit if count else len
        for part in tokens.lines(text):
            bare = part.lstrip()
            lengths.append(len(part))
            counts.append(unit(part))
            kinds.append((BLANK_BEFORE if _BLANK.match(part) else 0) | (FENCE if bare.lstrip("> ").startswith(("```", "~~~")) else 0))
        return lengths, counts, kinds

    def border(self, data: bytes, at: int, halo: int) -> tuple[int, bool]:
        """The cut before the nominal border ``at``, found from the bytes within ``halo`` of it alone, and whether a line begins there."""
        base = at - halo if at > halo else 0
        while base < at and data[base] & 0xC0 == 0x80:
            base += 1
        middle = at
        while middle > base and middle < len(data) and data[middle] & 0xC0 == 0x80:
            middle -= 1
        before, after = data[base:middle].decode("utf-8", "replace"), data[middle : at + halo].decode("utf-8", "ignore")
        around, most = before + after, len(before)
        for ends, is_line in ((tokens.LINES.finditer, True), (self.word_ends, False)):
            place = 0
            for m in ends(around, 0, min(len(around), most + 1 if not is_line else len(around))):
                if m.start() > most:
                    break
                place = m.start() or place
            if place:
                return base + len(around[:place].encode()), is_line
        return middle, False

    def segment(self, data: bytes, lead: int, first: bool, last: bool, range_bytes: int, halo: int) -> tuple[str, bool, int, int, bool]:
        """The range's own text, whether a line begins with it, its place in ``data``, whether a line begins behind it."""
        start, begins = (0, True) if first else self.border(data, lead, halo)
        stop, next_begins = (len(data), True) if last else self.border(data, lead + range_bytes, halo)
        stop = max(start, stop)
        return data[start:stop].decode("utf-8", "replace"), begins, start, stop, next_begins

    def stitched(self, tables: list[tuple], fenced: bool = False) -> tuple[list[int], list[int], list[int], list[bool]]:
        """Offsets, token sums, levels and fences at the lines of ranges (boundary table, whether a line begins with it), in order."""
        at, sums, level, inside = [0], [0], [3 if not tables or tables[0][1] else 0], []
        for table, begins in tables:
            joins = not begins and len(at) > 1
            for length, count, kind in zip(*table, strict=True):
                if not length and len(at) > 1:
                    continue
                if joins:
                    joins = False
                    at[-1] += length
                    sums[-1] += count
                    continue
                if len(at) > 1:
                    level[-1] = 1 if fenced else 3 if kind & BLANK_BEFORE else 2
                inside.append(fenced)
                if kind & FENCE and (begins or len(at) > 1):
                    fenced = not fenced
                at.append(at[-1] + length)
                sums.append(sums[-1] + count)
                level.append(3)
        return at, sums, level, [*inside, fenced]

    def ranges(self, text: str, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES) -> list[tuple]:
        """Boundary tables of all ranges of a text."""
        if 4 * len(text) <= range_bytes:
            return [(self.detect(text), True)]
        data = text.encode("utf-8", "surrogatepass")
        found = []
        for at in range(0, max(1, len(data)), range_bytes):
            first = max(0, at - halo)
            own, begins, *_ = self.segment(data[first : at + range_bytes + halo], at - first, at == 0, at + range_bytes >= len(data), range_bytes, halo)
            if own or not at:
                found.append((self.detect(own), begins))
        return found

    def split(self, text: str, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES) -> list[tuple[int, int, int, int]]:
        """(start, new_from, end, tokens) of each piece."""
        run = _Run(self, text, *self.stitched(self.ranges(text, range_bytes, halo))[:3])
        found, begin = [], 0
        size = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")) if 4 * len(text) > self.grid else 0
        for end in [*(a for a, _ in run.anchors(0, size, size, halo)), len(text)]:
            found += run.pieces(begin, end)
            begin = end
        return found


class _Run:
    """A text with its stitched table; lines are looked into only where a cut needs it."""

    def __init__(self, own: Splitter, text: str, at: list[int], sums: list[int], level: list[int]) -> None:
        self.own, self.text, self.at, self.sums, self.level = own, text, at, sums, level
        self.lines = max(1, len(at) - 1)
        self.inner: dict[int, tuple[list[int], list[int], bool]] = {}

    def line_of(self, at: int) -> int:
        return min(max(0, bisect_right(self.at, at) - 1), self.lines - 1)

    def part(self, n: int) -> str:
        return self.text[self.at[n] : self.at[n + 1]] if n + 1 < len(self.at) else ""

    def look(self, n: int) -> tuple[list[int], list[int], bool]:
        if n not in self.inner:
            if len(self.inner) > 64:
                self.inner.clear()
            self.inner[n] = self.own.line(self.part(n))
        return self.inner[n]

    def total(self, at: int) -> int:
        """Tokens before an offset that is a cut."""
        n = self.line_of(at)
        if at == self.at[n]:
            return self.sums[n]
        if n + 1 < len(self.at) and at == self.at[n + 1]:
            return self.sums[n + 1]
        offsets, sums, _ = self.look(n)
        return self.sums[n] + sums[bisect_right(offsets, at - self.at[n]) - 1]

    def cut_before(self, end: int) -> int:
        n = self.line_of(end - 1)
        offsets = self.look(n)[0]
        return self.at[n] + offsets[bisect_right(offsets, end - 1 - self.at[n]) - 1]

    def overlap_start(self, end: int) -> int:
        """The furthest cut before ``end`` with at most ``overlap`` tokens between."""
        left, n = self.own.overlap, self.line_of(max(0, end - 1))
        start = end
        while n >= 0 and left > 0:
            offsets, sums, _ = self.look(n)
            k = bisect_right(offsets, start - self.at[n]) - 1
            j = k
            while j and sums[k] - sums[j - 1] <= left:
                j -= 1
            left -= sums[k] - sums[j]
            start = self.at[n] + offsets[j]
            if j:
                break
            n -= 1
        return start

    def anchors(self, first: int, upto: int, size: int, halo: int) -> list[tuple[int, int]]:
        """(offset, line) of the anchor behind each multiple of the grid's bytes below ``upto``, the run beginning at byte ``first`` of a
        text of ``size`` bytes; none near its end.

        Of the lines that begin within an eighth of a halo of characters behind the multiple it is the first of the best level;
        where none begins, the next pretoken.
        """
        grid, found = self.own.grid, []
        start = max(grid, -(-first // grid) * grid)
        if start >= upto or start + grid // 4 > size:
            return found
        bytes_at = [first]
        for n in range(self.lines):
            bytes_at.append(bytes_at[-1] + len(self.part(n).encode("utf-8", "surrogatepass")))
        for target in range(start, upto, grid):
            if target + grid // 4 > size:
                break
            n = bisect_right(bytes_at, target) - 1
            if n >= self.lines:
                break
            place = self.at[n]
            if bytes_at[n] < target:
                part, offsets = self.part(n), self.look(n)[0]
                k = bisect_left(offsets, target - bytes_at[n], key=lambda o, p=part: len(p[:o].encode("utf-8", "surrogatepass")))
                place = self.at[n] + offsets[k] if k < len(offsets) else self.at[n + 1]
            best = (0, place, n)
            m = n if bytes_at[n] == target else n + 1
            while m < self.lines and self.at[m] - place <= halo // 8:
                if self.level[m] > best[0]:
                    best = (self.level[m], self.at[m], m)
                m += 1
            found.append(best[1:])
        return found

    def pieces(self, first_new: int, size: int) -> list[tuple[int, int, int, int]]:
        limit, found = self.own.limit, []
        if first_new >= size:
            return [(0, 0, 0, 0)] if not size else []
        start, whole = self.overlap_start(first_new) if first_new else 0, self.total(size)
        new = first_new
        while True:
            begun = self.total(start)
            piece = self._counted(start, new, size if whole - begun <= limit else self._end(new, begun))
            found.append(piece)
            new = piece[2]
            if new >= size:
                return found
            start = self.overlap_start(new)

    def _end(self, new: int, begun: int) -> int:
        """The best cut after ``new`` with at most ``limit`` tokens behind the first ``begun``."""
        limit, first = self.own.limit, self.line_of(new)
        last = max(first, bisect_right(self.sums, begun + limit) - 1)
        for level in _HARD:
            for n in range(last, first, -1):
                if self.sums[n] - begun < limit // 2:
                    break
                if self.level[n] >= level:
                    return self.at[n]
        n = min(last, self.lines - 1)
        base = self.sums[n]
        offsets, sums, _ = self.look(n)
        lo = max(0, bisect_right(offsets, max(0, new - self.at[n])) - 1)
        k = lo
        while k + 1 < len(offsets) and base + sums[k + 1] - begun <= limit:
            k += 1
        if k == lo:  # nothing more of this line fits
            return self.at[n] if self.at[n] > new else self.at[n] + offsets[min(lo + 1, len(offsets) - 1)]
        text = self.part(n)
        for j in range(k, lo, -1):
            if base + sums[j] - begun < limit // 2:
                break
            if _SENTENCE_END.search(text[max(0, offsets[j] - 12) : offsets[j]]):
                return self.at[n] + offsets[j]
        for j in range(k, max(lo, k - 40), -1):
            if offsets[j] == len(text) or text[offsets[j]].isspace():
                return self.at[n] + offsets[j]
        return self.at[n] + offsets[k]

    def _counted(self, start: int, new: int, end: int) -> tuple[int, int, int, int]:
        """Counts a piece with a cut inside a pretoken again, and shortens it should it be over the limit."""
        n = self.total(end) - self.total(start)
        ends = {self.line_of(start), self.line_of(max(start, end - 1))}
        if any(self.look(k)[2] for k in ends if self.at[min(k + 1, self.lines)] - self.at[k] > self.own.chunk):
            count = self.own.counter.count
            while (n := count(self.text[start:end])) > self.own.limit and (earlier := self.cut_before(end)) > new:
                end = earlier
        return start, new, end, n


OUT = "key long, stretch_no int, local_no int, start long, new_from long, stop long, tokens int, text string"
_SCHEMA = pa.schema([("key", pa.int64()), ("stretch_no", pa.int32()), ("local_no", pa.int32()), ("start", pa.int64()), ("new_from", pa.int64()), ("stop", pa.int64()), ("tokens", pa.int32()), ("text", pa.string())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)


def _split_here(limit: int, overlap: int, path: str, stretch: int, range_bytes: int, halo: int):
    """Texts whose ranges are all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Splitter(limit, overlap, path, stretch)
        for batch in batches:
            found: list[tuple] = []
            size = 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                size += len(text)
                found += [(key, 0, n, a, b, c, t, text[a:c]) for n, (a, b, c, t) in enumerate(own.split(text, range_bytes, halo))]
                if size > 2_000_000:
                    yield _rows(found)
                    found, size = [], 0
            yield _rows(found)

    return run


#: Rows (key, no, first, stop, ...) to the same rows with the bytes from first to stop in ``data``, each a task's own read.
Reader = Callable[[DataFrame], DataFrame]


def column_reader(frame: DataFrame) -> Reader:
    """Of texts in a column: key, body (binary). A text goes to one task, which deals out its parts."""

    def read(spans: DataFrame) -> DataFrame:
        rest = [c for c in spans.columns if c != "key"]
        of_key = spans.groupBy("key").agg(F.collect_list(F.struct(*rest)).alias("spans"))  # a value has less than 2 GB
        cut = frame.join(of_key, "key").select("key", "body", F.explode("spans").alias("s"))
        part = F.substring("body", (F.col("s.first") + 1).cast("int"), (F.col("s.stop") - F.col("s.first")).cast("int"))
        return cut.select("key", "s.*", part.alias("data")).repartition("key", "no")

    return read


def file_reader(files: DataFrame, tasks: int) -> Reader:
    """Of files in any storage that Arrow reads (key, path or URI): each task seeks to its part and reads no more than that.

    The rows are small before the bytes are there, so the number of ``tasks`` isn't left to their size.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for n, row in enumerate(batch.select(["path", "first", "stop"]).to_pylist()):
                system, name = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(name) as file:
                    data = file.read_at(row["stop"] - row["first"], row["first"])
                yield pa.RecordBatch.from_arrays([*batch.slice(n, 1).drop_columns(["path"]).columns, pa.array([data], pa.binary())], names=[*(c for c in batch.schema.names if c != "path"), "data"])

    def read(spans: DataFrame) -> DataFrame:
        named = spans.join(files.select("key", "path"), "key").select(*spans.columns, "path").repartition(tasks, "key", "no")
        schema = StructType([*spans.schema.fields, StructField("data", BinaryType())])
        return named.mapInArrow(fetch, schema)

    return read


def split_giant(sizes: DataFrame, read: Reader, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES, path: str = tokens.VOCABULARY, stretch: int = STRETCH_BYTES) -> DataFrame:
    """The pieces (columns of ``OUT``) of texts (key, size in bytes) that ``read`` reads in parts."""
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / range_bytes)).cast("int")
    spans = sizes.select("key", "size", count.alias("ranges")).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    nominal = F.col("no").cast("long") * range_bytes
    spans = spans.select("key", "no", "ranges", "size", F.greatest(F.lit(0), nominal - halo).alias("first"), F.least("size", nominal + range_bytes + halo).alias("stop"))

    def own_range(own: Splitter, row: dict) -> tuple[str, bool, int, int, bool]:
        return own.segment(row["data"], row["no"] * range_bytes - row["first"], row["no"] == 0, row["no"] == row["ranges"] - 1, range_bytes, halo)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Splitter(limit, overlap, path, stretch)
        for batch in batches:
            for row in batch.to_pylist():
                text, begins, start, stop, _ = own_range(own, row)
                lengths, _, kinds = own.detect(text, count=False)
                fences = sum(1 for n, k in enumerate(kinds) if k & FENCE and (n or begins))
                yield pa.RecordBatch.from_pydict({"key": [row["key"]], "no": pa.array([row["no"]], pa.int32()), "from": [row["first"] + start], "upto": [row["first"] + stop], "chars": [sum(lengths)], "fences": pa.array([fences], pa.int32())})

    table = checkpoint(read(spans).mapInArrow(detect, "key long, no int, from long, upto long, chars long, fences int"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = table.select("key", "no", "from", "upto", so_far("chars").alias("char_at"), (so_far("fences") % 2 == 1).alias("fenced"))
    # ranges that hold a multiple of the grid
    holding = placed.where(F.greatest(F.lit(1), F.ceil(F.col("from") / stretch)) * stretch < F.col("upto"))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Splitter(limit, overlap, path, stretch)
        for batch in batches:
            for row in batch.to_pylist():
                text, begins, start, stop, next_begins = own_range(own, row)
                behind = row["data"][stop:].decode("utf-8", "ignore")
                at, sums, level, inside = own.stitched([(own.detect(text, count=False), begins), (own.detect(behind, count=False), next_begins)], row["fenced"])
                run = _Run(own, text + behind, at, sums, level)
                found = run.anchors(row["from"], row["upto"], row["size"], halo)
                # a fence that begins with the line of an anchor inside it counts as open behind the anchor
                fenced = [inside[n] if run.at[n] == a else inside[n + 1] for a, n in found]
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array([row["key"]] * len(found), pa.int64()), "at": pa.array([row["from"] + len(run.text[:a].encode()) for a, _ in found], pa.int64()), "char_at": pa.array([row["char_at"] + a for a, _ in found], pa.int64()), "fenced": pa.array(fenced, pa.bool_()), "begins": pa.array([run.at[n] == a and level[n] > 0 for a, n in found], pa.bool_())}
                )

    asked = spans.join(holding.select("key", "no", "from", "upto", "char_at", "fenced"), ["key", "no"])
    later = checkpoint(read(asked).mapInArrow(anchor, "key long, at long, char_at long, fenced boolean, begins boolean"))
    starts = sizes.select("key", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("char_at"), F.lit(False).alias("fenced"), F.lit(True).alias("begins")).unionByName(later).join(sizes.select("key", "size"), "key")
    order = whole.orderBy("at")
    stretches = starts.select("key", (F.row_number().over(order) - 1).cast("int").alias("no"), F.greatest(F.lit(0), F.col("at") - halo).alias("first"), F.coalesce(F.lead("at").over(order), "size").alias("stop"), "at", "char_at", "fenced", "begins")

    def text_of(own: Splitter, row: dict) -> tuple[str, str]:
        """What serves as overlap, from the first sure end of a word in the halo on, and the stretch's own text."""
        cut = row["at"] - row["first"]
        lead, body = row["data"][:cut], row["data"][cut:].decode("utf-8", "replace")
        while row["first"] and lead and lead[0] & 0xC0 == 0x80:
            lead = lead[1:]
        tail = lead.decode("utf-8", "replace")
        return tail[next((m.start() for m in own.word_ends(tail) if m.start()), len(tail)) :] if row["first"] else tail, body

    lists = ("starts", "news", "ends", "tokens")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Splitter(limit, overlap, path, stretch)
        for batch in batches:
            for row in batch.to_pylist():
                tail, body = text_of(own, row)
                tables = [(own.detect(tail), True)] if tail else []
                fences = sum(k & FENCE > 0 for k in tables[0][0][2]) if tables else 0
                # the fence of the stretch's first line is known; those before it only turn it
                at, sums, level, _ = own.stitched([*tables, (own.detect(body), row["begins"])], row["fenced"] ^ (fences % 2 == 1))
                found = _Run(own, tail + body, at, sums, level).pieces(len(tail), len(tail) + len(body))
                yield pa.RecordBatch.from_pydict({"key": [row["key"]], "no": pa.array([row["no"]], pa.int32()), **{name: pa.array([[f[n] for f in found]], pa.list_(pa.int32())) for n, name in enumerate(lists)}})

    chosen = checkpoint(read(stretches).mapInArrow(choose, "key long, no int, " + ", ".join(f"{n} array<int>" for n in lists)))
    numbered = chosen.withColumn("number", F.coalesce(F.sum(F.size("starts")).over(before), F.lit(0)).cast("int"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Splitter(limit, overlap, path, stretch)
        for batch in batches:
            for row in batch.to_pylist():
                tail, body = text_of(own, row)
                text, shift = tail + body, row["char_at"] - len(tail)
                yield _rows([(row["key"], row["no"], row["number"] + n, a + shift, b + shift, c + shift, t, text[a:c]) for n, (a, b, c, t) in enumerate(zip(*(row[x] for x in lists), strict=True))])

    return read(stretches.join(numbered, ["key", "no"])).mapInArrow(emit, OUT)


def _named(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("key").alias("doc_id"), F.col("local_no").alias("piece_no"), "start", "new_from", "stop", "tokens", "text")


def split(frame: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES, path: str = tokens.VOCABULARY, stretch: int = STRETCH_BYTES, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """doc_id, piece_no, start, new_from, stop (in characters), tokens, text of each piece; start < new_from where it overlaps the one before."""
    rows = frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null")
    size = F.octet_length("text")
    is_giant = F.col("key").isNotNull() & (size > whole_bytes)
    here = rows.where(~is_giant).mapInArrow(_split_here(limit, overlap, path, stretch, range_bytes, halo), OUT)
    giant = rows.where(is_giant)
    sizes = checkpoint(giant.select("key", size.cast("long").alias("size")))
    if not sizes.isEmpty():
        read = column_reader(giant.select("key", F.col("text").cast("binary").alias("body")))
        here = here.unionByName(split_giant(sizes, read, limit, overlap, range_bytes, halo, path, stretch))
    return _named(here)


def split_files(spark: SparkSession, files: list[tuple[int, str, int]], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES, path: str = tokens.VOCABULARY, stretch: int = STRETCH_BYTES) -> DataFrame:
    """The same of files (key, path or URI, size in bytes) of a shared folder; no file is loaded whole."""
    listed = spark.createDataFrame(files, "key long, path string, size long")
    tasks = max(spark.sparkContext.defaultParallelism, sum(f[2] for f in files) // TASK_BYTES)
    return _named(split_giant(listed.select("key", "size"), file_reader(listed, tasks), limit, overlap, range_bytes, halo, path, stretch))


def files_of(frame: DataFrame, key: str, text: str, folder: str, file_bytes: int = 1 << 26) -> list[tuple[int, str, int]]:
    """Writes all texts in order of their keys, a blank line behind each, as large files of a shared folder; number, place and size of each file."""
    spark = frame.sparkSession
    rows = frame.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("value"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    rows.repartitionByRange(1 + total // file_bytes, "key").sortWithinPartitions("key").select("value").write.option("lineSep", "\n\n").text(folder)
    system, where = file_system(spark, folder)
    found = sorted((s.getPath().toString(), s.getLen()) for s in system.listStatus(where) if s.getPath().getName().startswith("part-"))
    return [(n, re.sub("^file:/+", "/", path), size) for n, (path, size) in enumerate(found) if size]
