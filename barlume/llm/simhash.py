"""SimHash near-duplicate groups by deletion-variant signatures.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Two
fingerprints link at three or fewer differing bits. Cut into two 32-bit segments, two such
fingerprints have a segment that differs in at most one bit, so they share one of its 32
variants with one bit left open. All variants are indexed, equal keys meet in an equality
shuffle, and the full distance is checked there.

Only distinct fingerprints are indexed: copies, however many, are one row. A key's bucket is
read as a stream and never held beyond ``bucket`` members: larger ones are cut again by
variants of the other segment (two 16-bit halves, one of which differs in at most one bit) and
those by the 4-bit pieces of the last half, one of which is equal. The last level leaves 14
open bits, so at most 16,384 distinct fingerprints can meet there, whatever the input.
From each bucket only a spanning forest of its links is emitted, never all pairs; the
components of that forest are those of all links.

A key that a large family shares would still stream through one task before it is cut. So keys that
show up ``HOT_HITS`` times among one in ``HOT_SAMPLE`` fingerprints go to the next level where they lie,
without meeting first. The sample only chooses the way: either way finds the same links. There are at most
64 n / (HOT_SAMPLE * HOT_HITS) such keys, 8 bytes each, for n fingerprints.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
repeated rows give repeated output rows; a null id takes part in linking, but the smallest
non-null id names the component (null if there is none); other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from barlume.llm.common import materialize, release, renamed

SEED = 42
MAX_BITS = 3
BUCKET = 1024
#: One in so many fingerprints is looked at to find keys that very many share, and so many of them make a key hot.
HOT_SAMPLE = 4096
HOT_HITS = 256


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text (words split at ASCII white space, A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, SEED) for g in grams], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of ``h``."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        votes += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a bucket's distinct fingerprints."""
    n, todo, out = len(fp), np.arange(len(fp)), []
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            u = front.pop()
            hit = np.bitwise_count(fp[todo] ^ fp[u]) <= bits
            if hit.any():
                for v in todo[hit]:
                    out.append((u, v))
                    front.append(v)
                todo = todo[~hit]
    assert n > len(out) or not n
    return out


def _bucket_links(bits: int, bucket: int | None):
    """Over rows (key, fp) sorted by key: links as (null, a, b), members of too large buckets as (key, fp, null)."""

    def rows(key: list, a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, over = None, np.empty(0, np.int64), False

        def close() -> tuple[list, list]:
            if over or len(held) < 2:
                return [], []
            fp = np.unique(held)
            found = _near(fp.view(np.uint64), bits)
            return [int(fp[u]) for u, _ in found], [int(fp[v]) for _, v in found]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            code = pc.run_end_encode(keys)
            ends = np.asarray(code.run_ends.to_numpy())
            values = code.values.to_pylist()
            a, b, ok, of = [], [], [], []
            start = 0
            for value, end in zip(values, ends.tolist(), strict=True):
                if value != held_key:
                    x, y = close()
                    a += x
                    b += y
                    held_key, held, over = value, fps[start:end], False
                else:
                    held = np.concatenate([held, fps[start:end]])
                if bucket and (over or len(held) > bucket):
                    over = True
                    ok += [held_key] * len(held)
                    of += held.tolist()
                    held = np.empty(0, np.int64)
                start = end
            if a:
                yield rows([None] * len(a), a, b)
            if ok:
                yield rows(ok, of, [None] * len(of))
            held = held.copy()
        x, y = close()
        if x:
            yield rows([None] * len(x), x, y)

    return run


def _meet(keyed: DataFrame, bits: int, bucket: int | None) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(bits, bucket), "key long, a long, b long")


def _slots(n: int) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s")


def _hot(keyed: DataFrame, sample: int, hits: int) -> DataFrame:
    """(key): those of ``keyed`` (key, fp) that very many fingerprints share, told from one in ``sample`` of them."""
    some = keyed.where(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(sample)) == 0)
    return some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= hits).select("key")


def links(distinct: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET, sample: int = HOT_SAMPLE, hits: int = HOT_HITS) -> DataFrame:
    """(a, b): enough links among the rows of ``distinct`` (fp, distinct) for all their components.

    Keys are longs: at the first level slot (segment, open bit) and segment, 38 bits; at the
    second those, slot and 16-bit half, 59 bits; at the third a hash of those, piece number and
    4-bit piece. A clash of hashes only merges buckets, whose members are compared anyway.
    """
    if bits > 3:
        raise ValueError("two segments with one open bit are complete up to 3 differing bits")
    first = distinct.select("fp", _slots(64)).select(
        F.expr("(cast(s as bigint) << 32) | (shiftrightunsigned(fp, 32 * (s div 32)) & 4294967295L & ~shiftleft(1L, s % 32))").alias("key"), "fp"
    )
    hot = materialize(_hot(first, sample, hits), "simhash-hot")
    rest, aside = first, None
    if not hot.isEmpty():
        aside = first.join(hot, "key", "left_semi")
        rest = first.join(hot, "key", "left_anti")
    met = materialize(_meet(rest, bits, bucket), "simhash-links")
    used = [hot, met]
    found = met.where("key is null").select("a", "b")
    large = met.where("key is not null").select("key", F.col("a").alias("fp"))
    large = large if aside is None else large.unionByName(aside.select("key", "fp"))
    if not large.isEmpty():
        base = "32 * (1 - cast(shiftright(key, 32) as int) div 32)"  # where the other segment starts
        second = large.select("key", "fp", F.expr(base).cast("int").alias("base"), _slots(32)).select(
            F.expr("(key << 21) | (cast(s as bigint) << 16) | (shiftrightunsigned(fp, cast(base + 16 * (s div 16) as int)) & 65535L & ~shiftleft(1L, s % 16))").alias("key"), "fp"
        )
        met = materialize(_meet(second, bits, bucket), "simhash-links2")
        used.append(met)
        found = found.union(met.where("key is null").select("a", "b"))
        large = met.where("key is not null").select("key", F.col("a").alias("fp"))
        if not large.isEmpty():
            base = "32 * (1 - cast(shiftright(key, 53) as int) div 32) + 16 * (1 - (cast(shiftright(key, 16) & 31L as int)) div 16)"
            third = large.select("key", "fp", F.expr(base).cast("int").alias("base"), _slots(4)).select(
                F.expr("xxhash64(key, s, shiftrightunsigned(fp, cast(base + 4 * s as int)) & 15L)").alias("key"), "fp"
            )
            found = found.union(_meet(third, bits, None).select("a", "b"))
    edges = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-edges")
    release(*used)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots: root is the component's smallest node.

    Alternating large-star and small-star steps; every step is a minimum by key and a join.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    was, last = None, None
    while True:  # every step lowers a node's neighbour or leaves all as it was, so this ends
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-low")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "star-large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "star-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "star")
        release(low, large, least, *([last] if last is not None else []))
        seen, last = state(now), now
        if seen == was:
            return renamed(now, "node", "root")
        was = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col, text_col, k), "simhash-fp")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    edges = links(distinct.select("fp"), bits, bucket)
    roots = components(edges)
    release(edges)
    member = materialize(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-member"
    )
    # only components of several fingerprints need their members' minimum
    named = member.join(roots.select("root").distinct(), "root", "left_semi")
    least = materialize(named.groupBy("root").agg(F.min("first_id").alias("least_id")), "simhash-least")
    known = materialize(
        member.join(least, "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "simhash-known"
    )
    release(distinct, roots, member, least)
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each id in ``kept`` (__kept_id), the one with the least hash of
    text and then of the whole row, and all rows without an id."""
    kept = kept.toDF(f"__kept_{uuid.uuid4().hex}")
    rows = docs.join(kept, docs[id_col] == kept[kept.columns[0]], "left_semi")
    order = [F.xxhash64(text_col), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])]
    row = f"__row_{uuid.uuid4().hex}"
    rows = rows.withColumn(row, F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col(row) == 1).drop(row)
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id names their group: one document of each group of near duplicates.

    Of rows that repeat the kept id the one with the least text hash stays; rows without an id
    stay (nothing names them).
    """
    kept = near_duplicates(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return one_each(docs, materialize(kept, "simhash-kept"), id_col, text_col)
