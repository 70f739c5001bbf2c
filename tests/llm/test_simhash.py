import random

import numpy as np
from pyspark.sql import functions as F

from barlume.llm import simhash


def groups(fps):
    """Brute force: smallest index reachable over links of 3 or fewer bits."""
    n, seen = len(fps), {}
    for i in range(n):
        if i in seen:
            continue
        todo = [i]
        while todo:
            u = todo.pop()
            if u in seen:
                continue
            seen[u] = i
            todo += [v for v in range(n) if v not in seen and (fps[u] ^ fps[v]).bit_count() <= 3]
    return seen


def check(spark, fps, bucket, **hot):
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    edges = simhash.links(df.select("fp").distinct(), bucket=bucket, **hot)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = groups(fps)
    of = lambda f: roots.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64)))
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(of(f), []).append(i)
    expect = {}
    for i, r in want.items():
        expect.setdefault(r, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def family(rng, centres, each, spread):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            f = c
            for b in rng.sample(range(64), rng.randint(0, spread)):
                f ^= 1 << b
            out.append(f)
    return out


def test_components_match_brute_force_in_one_level(spark):
    rng = random.Random(1)
    check(spark, family(rng, 40, 6, 4) + [rng.getrandbits(64) for _ in range(100)], 1024)


def test_components_match_brute_force_through_all_levels(spark):
    rng = random.Random(2)
    check(spark, family(rng, 3, 120, 3), 4)


def test_columns_edges_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, "a b c d e", "x"), (3, "A B  C\nD E", "y"), (9, None, "z"), (8, "", "z"), (7, "one", None), (7, "one", None), (1, long, "q"), (None, "one", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(out) == len(rows)
    by = {}
    for i, f, c in out:
        by.setdefault(i, set()).add((f, c))
    assert by[9] == by[8] == {("0" * 16, 8)}
    assert {c for _, c in by[5]} == {3} and {c for _, c in by[7]} == {7} and {c for _, c in by[None]} == {7}
    assert by[1] == {(f"{simhash.fingerprint(long):016x}", 1)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, 7, 1, None], key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_fingerprint_is_xxhash64_majority(spark):
    text = "Alpha beta Gamma delta"
    row = spark.createDataFrame([(text,)], "t string").select(F.xxhash64(F.lit("alpha beta gamma")).alias("a"), F.xxhash64(F.lit("beta gamma delta")).alias("b")).first()
    assert simhash.fingerprint(text) == (row.a & row.b) & (2**64 - 1)


def test_keys_of_large_families_skip_their_first_meeting(spark):
    """Keys told hot by the sample are cut where they lie; the links are those of a full comparison."""
    rng = random.Random(11)
    fps = family(rng, 3, 60, 3) + [rng.getrandbits(64) for _ in range(60)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
    keyed = df.withColumn("key", F.expr("shiftrightunsigned(fp, 40)"))
    many = keyed.groupBy("key").count().where("count >= 5").count()
    assert simhash._hot(keyed, 1, 5).count() == many > 0
    check(spark, fps, 16, sample=1, hits=5)
    check(spark, fps, 1024, sample=2, hits=2)
