"""The pipeline, stage by stage, against plain versions."""

import random
import re

import pytest

from barlume.llm import decontam, pii, quality
from tests.llm.test_contracts import ODD
from tests.llm.test_minhash import plain_kept

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row), row.index(min(row))


def test_myers_is_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 120)))
        want = distance(p, t)
        got = decontam.myers(decontam.pattern_masks(p), len(p), t, len(p))
        assert (got or (len(p), 0))[0] == want[0]
        if got and want[0] < len(p):
            assert got[1] == want[1]


def found(spark, docs, items, **more):
    """doc_id -> {item_id: (distance, start, end)}."""
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, h string, part int").repartition(5)
    out = {i: {} for i, _ in docs}
    for r in decontam.leaks(rows, spark.createDataFrame(items, "item_id long, text string").repartition(3), **more).collect():
        out[r.doc_id][r.item_id] = (r.distance, r.start, r.end)
    return out


@pytest.mark.parametrize("group", [decontam.GROUP, 2])
def test_matches_are_those_within_the_budget(spark, group):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 20, 45])))) for i in range(8 if group > 2 else 4)]
    docs = []
    for _, text in items:
        for edits in (0, 1, 3, 5, 30):
            bad = list(text.upper())
            for _ in range(edits):
                at = rng.randrange(len(bad))
                bad[at : at + 1] = rng.choice([[], ["z"], [bad[at], "q"]])
            docs.append((len(docs), " ".join(word() for _ in range(50)) + " \n" + "".join(bad) + ", " + " ".join(word() for _ in range(50))))
    got = found(spark, [*docs, (900, None), (901, "")], items, group=group)
    assert got[900] == got[901] == {}
    for i, doc in docs:
        norm = decontam.normalise(doc)
        for j, other in items:
            want = [distance(u, norm)[0] for u in decontam.units(other)]
            ok = [d for d, u in zip(want, decontam.units(other), strict=True) if d <= decontam.budget(u)]
            assert (got[i].get(j, (None,))[0]) == (min(ok) if ok else None), (i, j)


def test_quotes_and_short_items_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(26, 90)))) for i in range(40)] + [(None, "Who, then, won?"), (98, "two words"), (99, ""), (97, None)]
    docs = []
    for _, text in items[:40]:
        w = text.split()
        n = min(len(w), decontam.UNIT_WORDS + decontam.STRIDE - 1)
        for _ in range(10):
            at = rng.randrange(len(w) - n + 1)
            docs.append((len(docs), " ".join([*(word() for _ in range(30)), *w[at : at + n], *(word() for _ in range(30))])))
    docs += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(10)]
    docs += [(2000, "so who then won it"), (2001, "so who then wonders two words"), (2002, "xwho then won"), (2003, "Who then won"), (2004, "x" * 50 + " who then won")]
    got = found(spark, docs, items)
    assert all(i // 10 in got[i] for i in range(400)) and not any(got[1000 + i] for i in range(10))
    assert got[2000] == {None: (0, 3, 15)} and got[2001] == {} == got[2002] and got[2003] == {None: (0, 0, 12)} and got[2004] == {None: (0, 51, 63)}


def test_a_shared_lead_costs_no_more_for_more_items(spark):
    """Of many items with one lead only those are compared whose own words stand in the window."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    lead = "which of the following statements about the passage below is most likely true"
    items = [(i, f"{lead} {' '.join(word() for _ in range(10))}") for i in range(800)]
    asked = []
    plain = decontam.myers
    for n in (50, 200, 800):
        known = decontam.Pieces()
        for i, text in items[:n]:
            (unit,) = decontam.units(text)
            for at, p in decontam.pieces(unit, decontam.budget(unit)):
                if at == 0:
                    known.add(i, unit, decontam.budget(unit), p, 0)
        seen = []
        decontam.myers = lambda *a: seen.append(1) or plain(*a)
        try:
            target = decontam.normalise(items[7][1]).replace("e", "x", 2)
            near = f"{lead[:30]} {target[31:]} and so on"
            assert 7 in {uid for uid, *_ in known.match(0, 0, near)} or decontam.budget(target) < 3
            assert not list(known.match(0, 0, f"{lead} {' '.join(word() for _ in range(14))}"))
        finally:
            decontam.myers = plain
        asked.append(len(seen))
    assert asked[-1] <= asked[0] + 8, asked
    docs = [(i, f"{word()} {items[i][1]} {word()}") for i in range(0, 800, 40)] + [(5000 + i, " ".join(f"{lead} {word()} {word()}" for _ in range(30))) for i in range(5)]
    got = found(spark, docs, items, group=64)
    assert all(set(got[i]) == {i} for i in range(0, 800, 40)) and not any(got[5000 + i] for i in range(5))


def test_repeated_rows_and_shared_units(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank at noon"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, text.upper()), (None, text)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.distance) for r in decontam.leaks(docs, items).collect()))
    assert got == sorted((d, i, 0) for d in (0, 0, 1, 1) for i in (0, 7, 8))
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [2]
    assert decontam.clean(docs, items.limit(0)).count() == 5 and decontam.leaks(docs.limit(0), items).count() == 0


def test_upper_bound_is_exact():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality.upper_bound(3, 50, 0.025) == pytest.approx(0.16548, abs=1e-4)
    assert quality.upper_bound(5, 5, 0.1) == 1.0


def test_choose_controls_false_rejection():
    good, bad = [0] * 201, [0] * 201
    good[0], good[10], good[150], bad[0], bad[120], bad[199] = 2000, 300, 2, 50, 100, 40
    cut = quality.choose(good, bad, 0.02, 0.001)
    assert 10 <= cut < 120
    assert quality.choose([20] + [0] * 200, [1] * 201, 0.02, 0.001) is None  # too few to be certain
    assert quality.choose([0] * 201, [1] * 201, 0.02, 0.001) is None


def test_boosting_separates_and_calibrates():
    rng, rows = random.Random(0), []
    for _ in range(3000):
        x = [rng.randrange(n) for n in pii.SIZES]
        good = (x[1] in (2, 3)) ^ (x[3] == 1 and x[2] == 4)
        rows.append((*x, rng.randrange(2), int(good) * 10, int(not good) * 10))
    m = pii.boost(rows)
    import numpy as np

    k = len(pii.SIZES)
    x = np.array([r[:k] for r in rows])
    hit = m.score(x) >= m.threshold
    truth = np.array([r[k + 1] > 0 for r in rows])
    assert (hit & truth).sum() / hit.sum() > 0.9 and (hit & truth).sum() / truth.sum() > 0.3
    assert pii.boost([]).threshold == float("inf")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    at, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{name}")
        at = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert at.columns == docs.columns
    kept = {r.doc_id for r in frames["quality_rules"].collect()}
    failed = set()
    for i, r in before.items():
        n, _, _, _, _, rep = quality.counts(r.text)
        if n < 50 or 100 * rep > 50 * n:
            failed.add(i)
    assert not kept & failed
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in before if labels.get(i) == 1 and i not in failed]
    assert sum(i not in kept for i in good) <= 0.02 * len(good)
    want = plain_kept({i: before[i].text for i in kept})
    assert {r.doc_id for r in frames["near_duplicates"].collect()} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i in before if any(decontam.normalise(t) in decontam.normalise(before[i].text) for _, t in items)}
    left = {r.doc_id: r for r in frames["personal_data"].collect()}
    assert set(left) == {r.doc_id for r in frames["near_duplicates"].collect()} - held
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, r in left.items():
        assert not mail.search(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[i].text):
            assert r.text == before[i].text
    assert {r.doc_id for r in frames["tokens"].select("doc_id").collect()} == set(left)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, ODD[14], "en", "x", 1)] * 2 + [(3, "one", "en", "x", 1)] * 2, schema)
    for rows in (docs, docs.limit(0)):
        at = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, at, SF).write.parquet(f"{tmp_path}/{rows is docs}-{k}")
            at = spark.read.parquet(f"{tmp_path}/{rows is docs}-{k}")


def test_redaction_merges_overlaps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("é ab cd ef",), (None,)], "t string")
    spans = "array(named_struct('start', 5, 'order', 1, 'end', 7, 'kind', 'ip'), named_struct('start', 2, 'order', 0, 'end', 6, 'kind', 'email'), named_struct('start', 8, 'order', 0, 'end', 10, 'kind', 'card'))"
    assert [r[0] for r in df.select(pii.redact(F.col("t"), F.expr(spans))).collect()] == ["é [EMAIL] [CARD]", None]
