"""Vector code compression: product quantisation with partial-distance search.

A vector is cut into equal parts, and each part is replaced by the number of the nearest entry of
that part position's codebook. A nearest entry is looked for dimension by dimension, those in
which the codebook varies most first: a mask over all pairs of a part and an entry drops a pair
once its distance so far is above the part's best complete distance, and after each dimension
the pair that leads is completed, so the best falls as the search goes on. A pair that equals the
best stays, so ties go to the lowest entry. All distances are whole numbers and exact.

A round of training sums each entry's parts per task, then over tasks; what reaches the driver is one
sum per entry and dimension, whatever the number of rows. Vectors never move.

Defined results: rows whose vector is null or holds a null or an entry that is not finite are left out;
the width is that of the vector of the smallest id, and vectors of another width take no part in
training and get null for code and error; a width that the parts do not divide is cut at
floor(k * width / parts); null ids count as largest; repeated rows count and are returned one to
one; null labels are one label; with fewer rows than entries there are as many entries as rows; no
rows give no rows. Entries of any size are exact; an error sum beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlume.llm import vectors
from barlume.llm.common import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2


def cuts(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]


def order(book: np.ndarray) -> np.ndarray:
    """The dimensions of a codebook by falling variance, equal ones in their order."""
    return np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """As longs where no squared distance can leave their range, else as Python integers."""
    most = max((int(np.abs(a.astype(np.float64)).max()) for a in arrays if a.size), default=0)
    fits = 4 * (most + 1) ** 2 * max(1, arrays[0].shape[1]) < 2**62
    return [a if fits else a.astype(object) for a in arrays]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest row of ``book`` (the lowest of equals) and the squared distance."""
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    x, book = _exact(x, book)
    dims = order(book)
    far = (x[:, dims[0], None] - book[None, :, dims[0]]) ** 2
    guess = far.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(far <= best[:, None])  # by row, entries ascending
    far = far[row, entry]
    for step, dim in enumerate(dims[1:], 1):
        far = far + (x[row, dim] - book[entry, dim]) ** 2
        stays = far <= best[row]
        row, entry, far = row[stays], entry[stays], far[stays]
        if step < width - 1:
            lead = _first_least(row, far)
            best = np.minimum(best, ((x - book[entry[lead]]) ** 2).sum(axis=1))
    lead = _first_least(row, far)
    return entry[lead], far[lead]


def _first_least(row: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The place of each row's first least distance; every row has at least one."""
    new = np.r_[True, row[1:] != row[:-1]]
    least = np.minimum.reduceat(far, np.flatnonzero(new))
    hit = np.flatnonzero(far == least[np.cumsum(new) - 1])
    return hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]


def numbers(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(id, label, x) of the rows whose vector is finite."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = rows.where(vectors.finite(F.col(vector_col)))
    return kept.select(F.col(id_col).alias("id"), label.alias("label"), vectors.whole(F.col(vector_col)).alias("x"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, from the ``id`` and ``x`` of ``numbers``."""
    seeds = vectors.smallest(rows, entries)
    width = len(seeds[0]) if seeds else 0
    same = [s for s in seeds if len(s) == width]
    first = np.array(same, np.int64).reshape(len(same), width)
    books = [first[:, a:b] for a, b in cuts(width, parts)]
    used = rows.where(F.size("x") == width).select("x")
    for _ in range(rounds if width else 0):
        books = _moved(used, width, books)
    return books


def _moved(used: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    ends = cuts(width, len(books))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in vectors.blocks(batches, width):
            x = vectors.matrix(batch.column(0), width)
            for k, (a, b) in enumerate(ends):
                at, _ = nearest(x[:, a:b], books[k])
                count[k] += np.bincount(at, minlength=len(books[k]))
                (part,) = _exact(x[:, a:b])
                some = np.zeros(books[k].shape, part.dtype)
                np.add.at(some, at, part)
                total[k] += some
        out = [
            (k, e, d, int(count[k][e]), Decimal(int(total[k][e, d])))
            for k in range(len(books)) for e in np.flatnonzero(count[k]).tolist() for d in range(total[k].shape[1])
        ]
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "dim", "n", "total"])

    found = used.mapInArrow(sums, "part int, entry int, dim int, n long, total decimal(38,0)")
    new = [b.astype(object) for b in books]
    # one row per entry and dimension at most
    for r in found.groupBy("part", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        new[r.part][r.entry, r.dim] = int(r.total) // r.n
    return [b.astype(np.int64) for b in new]


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every row of ``numbers``."""
    width = sum(b.shape[1] for b in books)
    ends = cuts(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.blocks(batches, width):
            there = np.asarray(batch.column(2).is_valid())
            x = vectors.matrix(batch.column(2), width) if width else np.zeros((int(there.sum()), 0), np.int64)
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), object)
            for k, (a, b) in enumerate(ends):
                at, far = nearest(x[:, a:b], books[k])
                code[:, k] = at
                error += far
            codes, errors = np.full(len(there), None, object), np.full(len(there), None, object)
            codes[there] = [c.tobytes().hex() for c in code]
            errors[there] = [int(e) if e <= vectors.LONG else None for e in error]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    same = F.when(F.size("x") == width, F.col("x")).alias("x")
    return rows.select("id", "label", same).mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def sha256(books: list[np.ndarray]) -> str:
    """Lowercase hex of all entries' components by part, entry and dimension, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error) of every vector, and the codebooks.

    A label's errors are summed before they meet the rows again, so no label is one task's work.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    x = numbers(rows, id_col, vector_col, label_col)
    books = fit(x, parts, entries, rounds)
    coded = materialize(encode(x, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    per_label = materialize(coded.groupBy(F.col("label").alias("__of")).agg(total.alias("label_error")), "codes-labels")
    joined = coded.join(per_label, coded["label"].eqNullSafe(per_label["__of"]), "left")
    return joined.select("id", "label", "code", "error", "label_error"), books
