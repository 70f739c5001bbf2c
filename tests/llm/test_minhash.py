"""The near-duplicate stage of the pipeline against brute force over whole shingle sets."""

from collections import defaultdict
from itertools import combinations

import numpy as np

from barlume.llm import minhash

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_kept(texts):
    sets = plain_sets(texts)
    common = defaultdict(int)
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s or {None}:
            by[g].append(i)
    for ids in by.values():
        for pair in combinations(ids, 2):
            common[pair] += 1
    links = defaultdict(list)
    for (a, b), n in common.items():
        if not sets[a] or n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a].append(b)
            links[b].append(a)
    first = {}
    for i in sorted(texts):
        todo = [] if i in first else [i]
        while todo:
            u = todo.pop()
            if u not in first:
                first[u] = i
                todo += links[u]
    return {i for i in texts if first[i] == i}


def test_stage_keeps_one_of_all_that_are_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_kept({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(want)


def test_edited_copies_beyond_three_bits_go(spark):
    rng = np.random.default_rng(0)
    rows, gone = [], set()
    for i in range(0, 300, 3):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        near, far = list(words), list(words)
        near[50] = near[80] = "zz"  # 106 of 126 shingles are common
        for j in range(5, 115, 10):
            far[j] = "zz"
        rows += [(i, " ".join(words)), (i + 1, " ".join(near).upper()), (i + 2, " ".join(far))]
        gone.add(i + 1)
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - gone


def test_awkward_rows(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "one"), (6, "one"), (5, "ONE"), (None, "one"), (None, "none"), (4, "a b c d e f"), (3, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id for r in minhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([7, 5, 4, 3, None, None], key=str)
    assert minhash.keep_first(docs.limit(0)).count() == 0


def test_groups_over_many_tasks_are_those_of_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_kept({r.doc_id: r.text for r in docs.collect()})
    for members in (3, 10):  # most groups are dealt into chunks, rests and blocks
        kept = minhash.keep_first(docs, members=members)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_links_are_those_of_all_pairs_that_ask():
    rng = np.random.default_rng(1)
    base = [rng.integers(1, 1 << 63, 40, dtype=np.uint64) for _ in range(4)]
    for _ in range(30):
        sets = [np.unique(np.where(rng.random(40) < 0.1, rng.integers(1, 1 << 63, 40, dtype=np.uint64), b)) for b in base for _ in range(8)]
        sets.append(minhash.NO_WORDS)
        asks = rng.random(len(sets)) < 0.5
        known = rng.integers(0, 25, len(sets))
        want = list(range(len(sets)))
        for i, j in combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            alike = (asks[i] or asks[j]) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
            if alike or known[i] == known[j]:
                want = [want[i] if x == want[j] else x for x in want]
        got = minhash.link(sets, asks, known, 0.8).tolist()
        assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_of_rows_that_repeat_an_id_the_same_one_stays(spark):
    rows = [(1, "a b c d e"), (1, "f g h i j"), (1, "k l m n o"), (2, "f g h i j")]
    kept = [minhash.keep_first(spark.createDataFrame(r, "doc_id long, text string").repartition(n)).collect() for r, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and len(kept[0]) == 1
