"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Each whole text gives a row of statistics (lengths, shares of character classes, repeats, entropy). Scaled by
the training rows' mean and deviation, they are mapped by ``sqrt(2/D) cos(Wx + b)`` with normal W and
uniform b from a fixed seed: inner products of two such maps approximate a Gaussian kernel. Ridge
regression on the labels solves the normal equations, whose sums are taken per task and then over tasks;
the driver gets one number per pair of features. The raw scores become probabilities by isotonic
regression over a histogram of a third of the training rows, which the ridge fit does not see: documents whose
crc32 is 0 or 1 modulo 4 fit, 3 calibrates, 2 is held out from everything.

Statistics are taken once and written; a text is read once. Labels meet them by a join on ids, never texts.

Defined results: a null or empty text has statistics of zero and is scored like any other; a null id
has no label and is not held out; of several labels of a document the lowest counts, a null label is none;
repeated rows stay, one to one; without labels every score is 0.5, with labels of one class only, their
smoothed share; without rows to calibrate raw scores are cut to 0..1; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barlume.llm import quality
from barlume.llm.common import materialize

FEATURES = 192
RIDGE = 1e-3
SEED = 20240
BINS = 1024
LOW, HIGH = -0.25, 1.25  # of the histogram of raw scores
CUT = 0.7
CLIP = 5.0

STATISTICS = (
    "words", "word_bytes", "short_words", "long_words", "symbols", "upper", "digits", "stops", "marks",
    "dup_lines", "repeated", "distinct", "entropy", "line_words", "other_bytes", "odd_words",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``; each is about 0 to 5."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n_words, _, _, n_lines, n_dup, n_repeat = quality.counts(text)
    words = raw.split()
    n, n_bytes = max(1, n_words), len(raw)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    share = seen[seen > 0] / n_bytes
    last = np.frombuffer(bytes(w[-1] for w in words), np.uint8)
    odd = np.isin(last, _SYMBOLS) | np.isin(last, _MARKS)
    return [
        math.log1p(n_words) / 2,
        min(float(sizes.sum()) / n, 40.0) / 4,
        float((sizes <= 3).sum()) / n,
        float((sizes >= 12).sum()) / n,
        math.sqrt(float(seen[_SYMBOLS].sum()) / n_bytes),
        upper / max(1, upper + lower),
        math.sqrt(float(seen[48:58].sum()) / n_bytes),
        min(float(seen[_STOPS].sum()) / n, 2.0),
        math.sqrt(min(float(seen[_MARKS].sum()) / n, 4.0)),
        n_dup / max(1, n_lines),
        n_repeat / n,
        math.log1p(len(set(words))) / math.log1p(n),
        float(-(share * np.log2(share)).sum()),
        math.log1p(n_words / max(1, n_lines)),
        float(seen[128:].sum()) / n_bytes,
        float(odd.sum()) / n,
    ]


def part(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """The random Fourier map of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([math.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.at, self.level) if len(self.at) else raw, 0.0, 1.0)


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The non-decreasing rates of least weighted squared error, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # good, total, bins
    for g, t in zip(good.tolist(), total.tolist(), strict=True):
        blocks.append([g, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.concatenate([np.full(int(k), g / t) for g, t, k in blocks]) if blocks else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | float:
    """The model from the labelled rows that are not held out, or the one score that fits all."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("label"))
    rows = measured.join(known, "doc_id").select("x", "label", part(F.col("doc_id")).alias("part")).where("part <> 2")
    rows = materialize(rows, "rff-labelled")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < good < n:
        return (good + 1) / (n + 2)
    learnt = rows.where("part <> 3")
    if learnt.select("label").distinct().count() < 2:
        learnt = rows
    p = len(STATISTICS)
    found = learnt.agg(*(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([found[f"m{i}"] for i in range(p)])
    scale = np.array([found[f"s{i}"] if found[f"s{i}"] > 1e-9 else 1.0 for i in range(p)])
    rng = np.random.default_rng(seed)
    turn, shift = rng.standard_normal((p, features)) / math.sqrt(p), rng.uniform(0, 2 * math.pi, features)
    model = Model(mean, scale, turn, shift, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    model = Model(mean, scale, turn, shift, _ridge(learnt, model, features + 1, ridge), model.at, model.level)
    at, level = _calibrated(rows.where("part = 3"), model)
    return Model(mean, scale, turn, shift, model.weights, at, level)


def _ridge(rows: DataFrame, model: Model, size: int, ridge: float) -> np.ndarray:
    """Weights from normal equations summed per task, then over tasks; the constant is not shrunk."""
    i, j = np.triu_indices(size)
    i, j = np.r_[i, np.arange(size), -1], np.r_[j, np.full(size, -1), -1]  # column -1 is the right-hand side, (-1, -1) the count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            z = model.features(_matrix(b.column(0)))
            left += z.T @ z
            right += z.T @ np.asarray(b.column(1), np.float64)
            n += len(z)
        if n:
            k = len(i) - size - 1
            total = np.r_[left[i[:k], j[:k]], right, n]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total)], names=["i", "j", "total"])

    left, right, n = np.zeros((size, size)), np.zeros(size), 0.0
    for r in rows.select("x", "label").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        if r.i < 0:
            n = r.total
        elif r.j < 0:
            right[r.i] = r.total
        else:
            left[r.i, r.j] = left[r.j, r.i] = r.total
    shrink = np.full(size, ridge * n)
    shrink[-1] = 0
    return np.linalg.solve(left + np.diag(shrink), right)


def _calibrated(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and the rates there: isotonic over the histogram's used bins, a good and a bad one added at the ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for b in batches:
            raw = model.raw(_matrix(b.column(0)))
            k = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            total += np.bincount(k, minlength=BINS)
            good += np.bincount(k, np.asarray(b.column(1), np.float64), BINS).astype(np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k]), pa.array(good[k])], names=["bin", "total", "good"])

    found = rows.select("x", "label").mapInArrow(run, "bin int, total long, good long").groupBy("bin").agg(F.sum("total").alias("total"), F.sum("good").alias("good"))
    bins = sorted(found.collect())  # at most BINS rows
    if not bins:
        return np.zeros(0), np.zeros(0)
    at = LOW + (np.array([b.bin for b in bins]) + 0.5) * (HIGH - LOW) / BINS
    level = isotonic(np.array([b.total for b in bins], np.float64), np.array([b.good for b in bins], np.float64))
    return at, level


def score(measured: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every row."""
    if not isinstance(model, Model):
        return measured.select("doc_id", F.lit(float(model)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    measured = materialize(measure(docs, id_col, text_col), "rff-statistics")
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    scored = score(measured, fit(measured, labels, label_col="label"))
    held = F.coalesce(part(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
