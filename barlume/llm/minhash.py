"""Near-duplicate documents by Jaccard similarity of their word shingles: SimHash fingerprints
and min-hash bands as candidates, whole sets as proof.

Two documents link when the sets of their ``k``-word shingles have a similarity of ``similarity``
or more; groups are the components of all links. A candidate group is a component of

* fingerprints of the sets that differ in at most three bits (``simhash.links``), and
* bands: ``BANDS`` times ``ROWS`` minima of the shingles' hashes under as many linear maps. A pair
  at 0.8 shares one with probability 0.99994, a more similar one with a higher one. Fingerprints
  alone cannot reach 0.8: a bit of theirs differs with probability 0.15 there, so segments with
  one open bit would need 57 segments of 21 bits, 1,197 rows a document, for a like probability.

Nothing else is left to chance. Equal texts are one row; within a candidate group sets are
compared whole (64-bit hashes of the shingles), in tasks of at most about ``MEMBERS`` members or
``SHINGLES`` shingles:

* A group that fits is one task; its texts move once.
* A larger one is dealt into chunks by hash. All chunks also get the same ``PIVOTS`` members, so
  that the parts of one cluster find each other. What is then outside the group's largest
  component asks again, in blocks, all members that share a signature with it.

A member that is reached is never a target again, so m near copies of each other need about m
comparisons; only the unlinked are compared with all that share a signature.

Defined results: words are split at ASCII white space and A-Z lower-cased; a text of fewer than
``k`` words is one shingle; null and empty texts have no shingles and are alike; a null id takes
part in linking, but the smallest non-null id names the group; rows without an id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barlume.llm.common import materialize, release
from barlume.llm.simhash import MAX_BITS, SEED, components, links, majority, one_each

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
MEMBERS = 1024
SHINGLES = 1 << 20
PIVOTS = 32
_ROW = ("task", "asks", "t", "known", "text")
#: The one element of the set of a text without words.
NO_WORDS = np.zeros(1, np.uint64)
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_C = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return NO_WORDS
    grams = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], dtype=np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (_A[:, None] * found[None, at : at + 512] + _B[:, None]).min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    key = (least.reshape(BANDS, ROWS) * _C).sum(axis=1, dtype=np.uint64)
    key ^= key >> np.uint64(32)
    return (key * _C[:, 0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


class _Targets:
    """Members not yet reached, as one row of numbered shingles; those that ask come first."""

    def __init__(self, sets: list[np.ndarray], asks: np.ndarray) -> None:
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(self.sizes)
        self.own = [flat[e - n : e] for e, n in zip(ends.tolist(), self.sizes.tolist(), strict=True)]
        self.mark = np.zeros(int(flat.max()) + 1, bool)
        self.asks, self.left = asks, np.ones(len(sets), bool)
        self.pack(np.argsort(~asks, kind="stable"))

    def pack(self, members: np.ndarray) -> None:
        self.members = members
        self.asking = int(self.asks[members].sum())
        self.flat = np.concatenate([self.own[m] for m in members.tolist()]) if len(members) else np.empty(0, np.int64)
        self.starts = np.cumsum(self.sizes[members]) - self.sizes[members]

    def reach(self, members: np.ndarray) -> None:
        self.left[members] = False
        if 2 * (now := int(self.left[self.members].sum())) < len(self.members) or not now:
            self.pack(self.members[self.left[self.members]])

    def alike(self, u: int, similarity: float) -> np.ndarray:
        """Members left that are alike to ``u``; for one that doesn't ask, of those that do."""
        n = len(self.members) if self.asks[u] else self.asking
        if not n:
            return np.empty(0, np.int64)
        upto = self.starts[n] if n < len(self.members) else len(self.flat)
        self.mark[self.own[u]] = True
        both = np.add.reduceat(self.mark[self.flat[:upto]], self.starts[:n], dtype=np.int64)
        self.mark[self.own[u]] = False
        at = self.members[:n]
        return at[(both >= similarity * (self.sizes[at] + self.sizes[u] - both)) & self.left[at]]


def link(sets: list[np.ndarray], asks: np.ndarray, known: np.ndarray, similarity: float) -> np.ndarray:
    """The component of every member (a member's number), over links with a member that ``asks`` and over equal ``known``."""
    of = np.full(len(sets), -1)
    _, part = np.unique(known, return_inverse=True)
    order = np.argsort(part, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(part))[:-1])
    targets = _Targets(sets, asks)
    for i in np.flatnonzero(asks).tolist():
        if of[i] >= 0:
            continue
        new = [parts[part[i]]]
        front: list[int] = []
        while new or front:
            for members in new:
                of[members] = i
                targets.reach(members)
                front += members.tolist()
            hit = targets.alike(front.pop(), similarity)
            new = [parts[p] for p in np.unique(part[hit]).tolist()]
    alone = of < 0
    of[alone] = np.array([p[0] for p in parts])[part[alone]]
    return of


def _linked(k: int, similarity: float):
    """Over rows (task, asks, t, known, text) sorted by task: (t, least), t linked to the least t of its component in that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ts, asks, known, sets = None, [], [], [], []

        def close() -> pa.RecordBatch:
            of = link(sets, np.array(asks, bool), np.array(known, np.int64), similarity)
            t = np.array(ts, np.int64)
            least = np.full(len(t), np.iinfo(np.int64).max)
            np.minimum.at(least, of, t)
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(least[of])], names=["t", "least"])

        for b in batches:
            for r, a, t, x, text in zip(*(b.column(j).to_pylist() for j in range(4)), b.column(4), strict=True):
                if r == task and t == ts[-1]:
                    continue  # a repeated row
                if r != task:
                    if ts:
                        yield close()
                    task, ts, asks, known, sets = r, [], [], [], []
                ts.append(t)
                asks.append(a)
                known.append(x)
                sets.append(shingles(text.as_py(), k))
        if ts:
            yield close()

    return run


def _compare(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (t, least) of ``rows`` (task, asks, t, known, text)."""
    rows = rows.repartition("task").sortWithinPartitions("task", "t")
    return rows.mapInArrow(_linked(k, similarity), "t long, least long")


def _chunks(members: int, weight: F.Column, n: F.Column) -> F.Column:
    return F.greatest(F.ceil(weight / SHINGLES), F.ceil(n / members))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, members: int = MEMBERS) -> DataFrame:
    """(t, component_id) for every distinct text, by its hash ``t``: the smallest id of its group."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), k) for x in b.column(2)]
            flat = pa.array(np.concatenate([bands(s) for s in sets]) if sets else np.empty(0, np.int64))
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            fp = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, fp, pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "t", "n", "fp", "keys"])

    sketched = rows.mapInArrow(sketch, "doc_id long, t long, n long, fp long, keys array<long>")
    distinct = sketched.groupBy("t").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", "fp", "keys")))
    distinct = materialize(distinct, "similar-distinct")

    # candidates: the first member of a band or fingerprint stands for it, so that a cluster gets edges, not pairs
    held = distinct.select("t", F.explode("keys").alias("key"))
    first = held.groupBy("key").agg(F.min("t").alias("a"), F.count("*").alias("size")).where("size > 1").select("key", "a")
    met = held.join(first, "key").where("a <> t").select("a", F.col("t").alias("b"))
    prints = materialize(distinct.groupBy("fp").agg(F.min("t").alias("a"), F.count("*").alias("size")), "similar-prints")
    same = distinct.join(prints.where("size > 1").select("fp", "a"), "fp").where("a <> t").select("a", F.col("t").alias("b"))
    near = links(prints.select("fp"), MAX_BITS)
    name = prints.select("fp", F.col("a").alias("t"))
    near = near.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select("x", "y")
    edges = materialize(met.union(same).union(near).distinct(), "similar-candidates")
    roots = components(edges)
    release(edges, prints)
    members_of = roots.union(roots.select("root", "root").distinct()).toDF("t", "root")
    asked = materialize(distinct.select("t", "n", "first_id").join(members_of, "t").select("root", "t", "n", "first_id"), "similar-asked")
    sizes = materialize(asked.groupBy("root").agg(_chunks(members, F.sum("n"), F.count("*")).alias("chunks")), "similar-sizes")
    dealt = asked.join(sizes, "root")
    # the one time that texts of candidates leave their place; always by a shuffle, so that no size has another plan
    texts = rows.withColumnRenamed("t", "of").join(dealt.hint("merge"), (F.col("of") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = materialize(texts.select("root", "t", "chunks", "text"), "similar-texts")
    release(roots)
    whole = texts.where("chunks = 1").select(F.col("root").alias("task"), F.lit(True).alias("asks"), "t", F.col("t").alias("known"), "text")
    linked = materialize(_compare(whole, k, similarity), "similar-linked")
    large, found, spent = dealt.where("chunks > 1").select("root", "t", "n", "chunks"), linked, [linked]
    if not large.isEmpty():
        more = _large(large, distinct, texts.where("chunks > 1").select("t", "text"), k, similarity, members)
        found = found.union(more)
        spent.append(more)
    release(texts)
    least = materialize(asked.select("t", "first_id").join(found, "t").groupBy("least").agg(F.min("first_id").alias("component_id")), "similar-least")
    named = found.join(least, "least").select("t", "component_id")
    out = distinct.select("t", "first_id").join(named, "t", "left").select("t", F.coalesce("component_id", "first_id").alias("component_id"))
    out = materialize(out, "similar-groups")
    release(distinct, asked, sizes, least, *spent)
    return out


def _large(large: DataFrame, distinct: DataFrame, texts: DataFrame, k: int, similarity: float, members: int) -> DataFrame:
    """(t, least) for the members of groups that are more than one task."""
    chunk = F.pmod(F.xxhash64("t", F.lit(1)), "chunks")
    pivots = large.withColumn("slot", F.pmod(F.xxhash64("t", F.lit(2)), F.lit(PIVOTS))).groupBy("root", "slot").agg(F.min("t").alias("t"), F.first("chunks").alias("chunks"))
    pivots = pivots.select("root", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = large.select("root", "t", chunk.alias("chunk")).union(pivots.select("root", "t", "chunk")).distinct()
    dealt = dealt.select(F.xxhash64("root", "chunk").alias("task"), F.lit(True).alias("asks"), "t", F.col("t").alias("known"))
    linked = materialize(_compare(dealt.join(texts, "t").select(*_ROW), k, similarity), "similar-chunks")
    edges = linked.where("t <> least").toDF("a", "b").distinct()
    near = components(edges)
    known = large.join(near.toDF("t", "known"), "t", "left").select("root", "t", "n", F.coalesce("known", "t").alias("known"))
    known = materialize(known, "similar-known")
    release(near)
    parts = known.groupBy("root", "known").agg(F.count("*").alias("size"))
    main = parts.groupBy("root").agg(F.max_by("known", F.struct("size", "known")).alias("main"))
    rest = known.join(main, "root").where("known <> main").drop("main")

    # what is outside the largest part asks, in blocks, the members that share a signature with it
    blocks = rest.groupBy("root").agg(_chunks(members, F.sum("n"), F.count("*")).alias("blocks"))
    rest = rest.join(blocks, "root").withColumn("block", F.xxhash64("root", F.pmod(F.xxhash64("t", F.lit(3)), "blocks")))
    rest = materialize(rest.select("block", "t", "n", "known"), "similar-rest")
    signs = materialize(known.join(distinct.select("t", "keys"), "t").select("t", "n", "known", F.explode("keys").alias("key")), "similar-signs")
    asking = rest.select("block", "t").join(signs.select("t", "key"), "t").select("block", "key").distinct()
    answer = signs.join(asking, "key").select("block", "t", "n", "known").distinct()
    found = materialize(answer.join(rest.select("block", "t"), ["block", "t"], "left_anti"), "similar-answer")
    parts = found.groupBy("block").agg(_chunks(members, F.sum("n"), F.count("*")).alias("parts"))
    answer = found.join(parts, "block").select("block", F.pmod(F.xxhash64("t", F.lit(4)), "parts").alias("part"), F.lit(False).alias("asks"), "t", "known")
    everywhere = rest.join(parts, "block", "left").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(True).alias("asks"), "t", "known"
    )
    asked = answer.union(everywhere).select(F.xxhash64("block", "part").alias("task"), "asks", "t", "known")
    more = materialize(_compare(asked.join(texts, "t").select(*_ROW), k, similarity), "similar-more")
    edges = materialize(edges.union(more.where("t <> least").toDF("a", "b")).distinct(), "similar-edges")
    near = components(edges)
    out = materialize(large.join(near.toDF("t", "least"), "t", "left").select("t", F.coalesce("least", "t").alias("least")), "similar-large")
    release(linked, known, rest, signs, found, more, edges, near)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, members: int = MEMBERS) -> DataFrame:
    """Rows of ``docs`` whose id names their group: one document of each group of near duplicates.

    Of rows that repeat the kept id the one with the least text hash stays; rows without an id
    stay (nothing names them).
    """
    found = groups(docs, id_col, text_col, k, similarity, members)
    kept = materialize(found.where("component_id is not null").select(F.col("component_id").alias("__kept_id")).distinct(), "similar-kept")
    release(found)
    return one_each(docs, kept, id_col, text_col)
