"""Benchmark decontamination by pigeonhole edit matching.

A test item has an error budget of one edit per ``PIECE`` characters. Cut into budget + 1 pieces,
any text within the budget holds one piece untouched, so every item stands among the exact piece
hits. Around a hit the document's window is compared with the item by Myers' bit-parallel distance (the
item anywhere in the window, pattern bits in one integer). Item and document are lower-cased and runs of
anything but letters and digits are one space. Items of more than ``UNIT_WORDS`` words are searched as windows
of so many, ``STRIDE`` words apart, each with its own budget: a verbatim quote of ``UNIT_WORDS + STRIDE - 1``
words is always found, a shorter one where it holds a window. Edits spread over a long item leave some window
with no more than its share of them. Items under ``LEAST_CHARS`` characters, of ``LEAST_WORDS`` words or
more, must stand there verbatim, between words.

Documents are scanned once, whatever the size of the benchmark, which never goes through the driver:

1. A piece is known by the rolling hash of its first characters. Two tables of ``BUCKETS`` bytes tell for each
   bucket of hashes how much text before and after a hit its units may need; these tables are all that is broadcast.
2. One pass over the documents hashes every position and puts out, where a bucket is taken, the hash, the place and
   the text around it. No document is moved.
3. Hits and pieces meet by hash. A hash of very many hits or units (a common lead of a question set) is dealt
   into parts and chunks of ``GROUP`` rows first. Where a piece is shared by more than ``FEW`` units, those are
   asked by their rarer 4-grams: by the q-gram lemma a unit of m characters within k edits keeps at least
   m - 3 - 4 k of its 4-grams, so only units of which enough rare ones stand in the window are compared. The time does
   not follow the number of items that share a lead.

Defined results: null and empty texts, and items of fewer than ``LEAST_WORDS`` words that are under
``LEAST_CHARS`` characters, match nothing; items without an id are one, with a null id; a repeated
document row gives its matches again; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlume.llm.common import materialize, release

PIECE = 12
UNIT_WORDS = 25
STRIDE = 5
LEAST_CHARS = 40
LEAST_WORDS = 3
#: Characters of a piece of a short item that are hashed; longer pieces are hashed by their first ``PIECE``.
SHORT = 5
BUCKETS = 1 << 23
#: Characters that one step of a bucket's reach stands for; the last step is the whole text.
STEP, WHOLE = 32, 255
#: Hashes up to this number are also held exactly, so that buckets that are taken by chance put out nothing.
EXACT = 1 << 21
GROUP = 4096
FEW = 8
#: A 4-gram is rare where at most so many units of a group have it; units with too few such ones are asked at the next level.
LEVELS = (16, 128, 1024)
Q = 4
SCAN_CHARS = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def units(text: str | None, unit_words: int = UNIT_WORDS) -> list[str]:
    """The normalised item, or if it is longer its windows of ``unit_words`` words."""
    whole = normalise(text)
    words = whole.split(" ")
    if len(whole) < LEAST_CHARS and len(words) < LEAST_WORDS:
        return []
    if len(words) <= unit_words:
        return [whole]
    starts = [*range(0, len(words) - unit_words, STRIDE), len(words) - unit_words]
    return list(dict.fromkeys(" ".join(words[s : s + unit_words]) for s in starts))


def budget(unit: str, piece: int = PIECE) -> int:
    """Edits; 0 for a short unit, which must also stand between words."""
    return 0 if len(unit) < LEAST_CHARS else max(0, len(unit) // piece - 1)


def pieces(unit: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors`` + 1 consecutive pieces of nearly equal length."""
    n = errors + 1
    cuts = [len(unit) * i // n for i in range(n + 1)]
    return [(cuts[i], unit[cuts[i] : cuts[i + 1]]) for i in range(n)]


def pattern_masks(unit: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(unit):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end): the least edit distance of the pattern to any part of ``text``, the first end
    that has it; None beyond ``most``. Myers 1999: a column of differences in two m-bit integers."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # the pattern may start anywhere: no carry into the first row
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


# --- hashing ------------------------------------------------------------------------------------------------


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` code points that follow each other."""
    size = len(x) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = h * _B + x[i : i + size] + np.uint64(1)
    h ^= h >> np.uint64(31)
    return h * _M


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def anchor(piece: str, width: int = PIECE) -> int:
    """The hash that a piece is found by, as a signed long."""
    n = width if len(piece) >= width else SHORT
    return int(rolling(points(piece[:n]), n).view(np.int64)[0])


def _steps(n: int) -> int:
    return min(WHOLE, -(-n // STEP))


# --- comparing ----------------------------------------------------------------------------------------------


class Group:
    """The units that have one piece at one place: which of them may be in a window."""

    def __init__(self, units: list[tuple[int, str, int]]):
        self.units = units  # (uid, unit, budget)
        self.reach, self.slack = max(len(u) + 2 * k for _, u, k in units), max(2 * k for *_, k in units)
        self.levels: list[tuple[dict[str, list[int]], np.ndarray]] = []
        left = range(len(units))
        if len(units) <= FEW:
            self.always = list(left)
            return
        every = [[u[i : i + Q] for i in range(len(u) - Q + 1)] for _, u, _ in units]
        for most in LEVELS:
            count: dict[str, int] = {}
            for u in left:
                for g in set(every[u]):
                    count[g] = count.get(g, 0) + 1
            index: dict[str, list[int]] = {}
            need, rest = np.full(len(units), 1 << 30), []
            for u in left:
                rare = [g for g in every[u] if count[g] <= most]
                if len(rare) > Q * units[u][2]:
                    need[u] = len(rare) - Q * units[u][2]
                    for g in rare:
                        index.setdefault(g, []).append(u)
                else:
                    rest.append(u)
            self.levels.append((index, need))
            left = rest
        self.always = left

    def maybe(self, window: str) -> list[int]:
        """Units that may stand in the window within their budgets."""
        found = list(self.always)
        if self.levels:
            grams = {window[i : i + Q] for i in range(len(window) - Q + 1)}
            for index, need in self.levels:
                seen: dict[int, int] = {}
                for g in grams:
                    for u in index.get(g, ()):
                        seen[u] = seen.get(u, 0) + 1
                found += [u for u, n in seen.items() if n >= need[u]]
        return found


class Pieces:
    """The units of one hash, by piece and place."""

    def __init__(self):
        self.rows: dict[tuple[str, int], list[tuple[int, str, int]]] = {}
        self.groups: dict[tuple[str, int], Group] = {}
        self.masks: dict[str, dict[str, int]] = {}

    def add(self, uid: int, unit: str, errors: int, piece: str, at: int) -> None:
        self.rows.setdefault((piece, at), []).append((uid, unit, errors))

    def match(self, place: int, start: int, window: str) -> Iterator[tuple[int, int, int, int]]:
        """(uid, distance, start, end) of the units that stand around ``place``; ``window`` is the text from ``start`` on."""
        here = place - start
        for (piece, at), units in self.rows.items():
            if not window.startswith(piece, here):
                continue  # another piece of the same hash
            if (piece, at) not in self.groups:
                self.groups[piece, at] = Group(units)
            group, begin = self.groups[piece, at], here - at
            for i in group.maybe(window[max(0, begin - group.slack) : begin + group.reach]):
                uid, unit, k = units[i]
                if len(unit) < LEAST_CHARS:
                    if (begin == 0 or window[begin - 1] == " ") and window[begin + len(unit) : begin + len(unit) + 1] in ("", " "):
                        yield uid, 0, start + begin, start + begin + len(unit)
                    continue
                low = max(0, begin - 2 * k)
                if begin >= 0 and window.startswith(unit, begin):
                    yield uid, 0, start + low, start + begin + len(unit)
                    continue
                if unit not in self.masks:
                    self.masks[unit] = pattern_masks(unit)
                hit = myers(self.masks[unit], len(unit), window[low : begin + len(unit) + 2 * k], k)
                if hit:
                    yield uid, hit[0], start + low, start + low + hit[1]


# --- the benchmark ------------------------------------------------------------------------------------------


def _units(benchmark: DataFrame, item_col: str, text_col: str, unit_words: int) -> DataFrame:
    """(item_id, unit) of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, u) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for u in units(t, unit_words)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "unit"])

    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    return rows.mapInArrow(run, "item_id long, unit string").distinct()


def _pieces(found: DataFrame, piece: int) -> DataFrame:
    """(h, uid, unit, errors, piece, at, before, after): the last two are the text that the unit may need around the piece, in steps."""
    names = ["h", "uid", "unit", "errors", "piece", "at", "before", "after"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = budget(unit, piece)
                for at, p in pieces(unit, k):
                    rows.append((anchor(p, piece), uid, unit, k, p, at, _steps(at + 2 * k + 1), _steps(len(unit) - at + 2 * k + 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return found.select("uid", "unit").distinct().mapInArrow(run, "h long, uid long, unit string, errors int, piece string, at int, before int, after int")


def _tables(cut: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Steps of text before and after a hit by bucket of its hash, and all hashes if they are few. At most ``BUCKETS`` and
    ``EXACT`` rows reach the driver, whatever the benchmark."""
    bucket = F.shiftrightunsigned("h", 64 - (BUCKETS.bit_length() - 1))
    rows = cut.groupBy(bucket.cast("long").alias("bucket")).agg(F.max("before").alias("before"), F.max("after").alias("after")).toArrow()
    before, after = np.zeros(BUCKETS, np.uint8), np.zeros(BUCKETS, np.uint8)
    at = rows.column("bucket").to_numpy()
    before[at], after[at] = rows.column("before").to_numpy(), rows.column("after").to_numpy()
    known = cut.select("h").distinct().limit(EXACT + 1).toArrow().column("h").to_numpy()
    return before, after, np.sort(known.view(np.uint64)) if len(known) <= EXACT else None


# --- the documents ------------------------------------------------------------------------------------------

_HIT = "h long, doc_id long, doc_hash long, place int, start int, text string"


def _scan(docs: DataFrame, tables: tuple, widths: tuple[int, ...]) -> DataFrame:
    """Every place of ``docs`` (doc_id, doc_hash, text) that may begin a piece, with the text its units may need."""
    held = docs.sparkSession.sparkContext.broadcast(tables)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))

    def found(texts: list[str]) -> Iterator[tuple[int, int, int, int, str]]:
        """(text, hash, place, start, window)."""
        before, after, exact = held.value
        joined = "\0".join(texts)  # no piece holds the mark between texts
        ends = np.cumsum([len(t) + 1 for t in texts])
        x = points(joined)
        for n in widths:
            h = rolling(x, n)
            at = np.flatnonzero(after[(h >> shift).astype(np.int64)])
            if n == SHORT:  # short items stand between words
                at = at[(at == 0) | np.isin(x[at - 1], (0, 32))]
            if exact is not None and len(at):
                i = np.minimum(np.searchsorted(exact, h[at]), len(exact) - 1)
                at = at[exact[i] == h[at]] if len(exact) else at[:0]
            of = np.searchsorted(ends, at, side="right")
            for p, d in zip(at.tolist(), of.tolist(), strict=True):
                text = texts[d]
                place = p - (int(ends[d]) - len(text) - 1)
                if place + n > len(text):
                    continue
                bucket = int(h[p] >> shift)
                low = 0 if before[bucket] == WHOLE else max(0, place - STEP * int(before[bucket]))
                high = len(text) if after[bucket] == WHOLE else place + STEP * int(after[bucket])
                yield d, int(h[p : p + 1].view(np.int64)[0]), place, low, text[low:high]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _HIT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts: list[str] = []
            first, size = 0, 0
            for i, t in enumerate(b.column(2)):
                texts.append(normalise(t.as_py()))
                size += len(texts[-1])
                if size >= SCAN_CHARS or i == b.num_rows - 1:
                    rows = [(h, ids[first + d], hashes[first + d], place, start, window) for d, h, place, start, window in found(texts)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)
                    first, texts, size = i + 1, [], 0

    return docs.mapInArrow(run, _HIT)


def _dealt(hits: DataFrame, cut: DataFrame, group: int) -> DataFrame:
    """(h, part, chunk, side, ...): units (side 0) and hits (side 1) that are to meet. Hashes with more than ``group`` hits are
    dealt into parts, those with more units into chunks; each part meets each chunk."""
    size = lambda df, name: df.groupBy("h").agg(F.ceil(F.count("*") / group).cast("int").alias(name)).where(F.col(name) > 1)
    parts, chunks = materialize(size(hits, "parts"), "leaks-parts"), materialize(size(cut, "chunks"), "leaks-chunks")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    own = lambda n, *of: F.coalesce(F.pmod(F.xxhash64(*of), F.col(n)).cast("int"), F.lit(0))
    of_hits = hits.join(parts, "h", "left").join(chunks, "h", "left").select(
        "h", own("parts", "doc_id", "doc_hash", "place").alias("part"), upto(F.col("chunks")).alias("chunk"), F.lit(1).alias("side"), "doc_id", "doc_hash", "place", "start", "text"
    )
    of_units = cut.join(parts, "h", "left").join(chunks, "h", "left").select(
        "h", upto(F.col("parts")).alias("part"), own("chunks", "uid", "at").alias("chunk"), F.lit(0).alias("side"),
        F.col("uid").alias("doc_id"), F.lit(None).cast("long").alias("doc_hash"), F.col("at").alias("place"), F.col("errors").alias("start"), F.col("unit").alias("text"), "piece",
    )
    both = of_hits.unionByName(of_units, allowMissingColumns=True)
    return both.repartition("h", "part", "chunk").sortWithinPartitions("h", "part", "chunk", "side")


def _compared(dealt: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, uid, distance, start, end) of every hit whose unit stands there."""
    names = ["doc_id", "doc_hash", "uid", "distance", "start", "end"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, Pieces()
        for b in batches:
            rows: list[tuple] = []
            for h, part, chunk, side, doc_id, doc_hash, place, start, text, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, part, chunk) != key:
                    key, known = (h, part, chunk), Pieces()
                if side:
                    rows += [(doc_id, doc_hash, *found) for found in known.match(place, start, text)]
                else:
                    known.add(doc_id, text, start, piece, place)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    columns = ["h", "part", "chunk", "side", "doc_id", "doc_hash", "place", "start", "text", "piece"]
    return dealt.select(*columns).mapInArrow(run, "doc_id long, doc_hash long, uid long, distance int, start int, end int")


def _found(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, piece: int, unit_words: int, group: int) -> DataFrame:
    """(doc_id, doc_hash, item_id, distance, start, end) of ``rows`` (doc_id, doc_hash, text), copies of a row once; a written frame."""
    asked = materialize(_units(benchmark, item_col, item_text_col, unit_words).withColumn("uid", F.xxhash64("unit")), "leaks-units")
    cut = materialize(_pieces(asked, piece), "leaks-pieces")
    tables = _tables(cut)
    hits = materialize(_scan(rows, tables, (piece, SHORT)), "leaks-hits")
    matched = materialize(_compared(_dealt(hits, cut, group)), "leaks-compared")
    best = matched.join(asked.select("uid", "item_id"), "uid").groupBy("doc_id", "doc_hash", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("x"))
    out = materialize(best.select("doc_id", "doc_hash", "item_id", "x.*"), "leaks")
    release(asked, cut, hits, matched)
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    piece: int = PIECE, unit_words: int = UNIT_WORDS, group: int = GROUP,
) -> DataFrame:
    """(doc_id, item_id, distance, start, end): a row for each item found in each document; places are in the normalised
    text, and start is where the window that was compared begins."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), text.alias("text"))
    found = _found(rows, benchmark, item_col, item_text_col, piece, unit_words, group)
    # rows that repeat id and text: how many, of those that hold an item
    own = found.select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).distinct()
    copies = rows.select("doc_id", "doc_hash").join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("doc_hash") == F.col("__hash")), "left_semi")
    copies = copies.groupBy(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).agg(F.count("*").alias("copies"))
    out = found.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("doc_hash") == F.col("__hash")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "item_id", "distance", "start", "end")


def clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    piece: int = PIECE, unit_words: int = UNIT_WORDS, group: int = GROUP,
) -> DataFrame:
    """Rows of ``docs`` that hold no item."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), text.alias("text"))
    found = _found(rows, benchmark, item_col, item_text_col, piece, unit_words, group)
    gone = materialize(found.select(F.col("doc_id").alias("__leak_id"), F.col("doc_hash").alias("__leak_hash")).distinct(), "leaks-docs")
    release(found)
    same = docs[id_col].cast("long").eqNullSafe(gone["__leak_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == gone["__leak_hash"])
    return docs.join(gone, same, "left_anti")
