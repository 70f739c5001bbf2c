"""Journals over restarts."""

import pytest

from barlume.streaming import journal


def files(spark, path, *parts):
    for part in parts:
        spark.createDataFrame(part, "k string, t long").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("k string, t long").option("maxFilesPerTrigger", 1).parquet(path)


def test_a_journal_neither_loses_nor_repeats_rows(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "journal")
    rows = [[("a", i), ("b", i)] for i in range(3)]
    die = {"at": 1}

    def before(batch):
        if batch == die["at"]:
            raise InterruptedError("killed")

    with pytest.raises(Exception, match="killed"):
        journal.write(files(spark, path, *rows), root, before)
    assert journal.batches(spark, root) == [0] and journal.read(spark, root).count() == 2
    die["at"] = 2
    with pytest.raises(Exception, match="killed"):
        journal.write(files(spark, path), root, before)
    journal.write(files(spark, path, [("c", 9)]), root)
    want = [r for part in rows for r in part] + [("c", 9)]
    assert sorted(map(tuple, journal.read(spark, root).collect())) == sorted(want)
    # rows of dead attempts lie there, unseen; a batch that is there is not taken twice
    assert len(list((tmp_path / "journal/data").iterdir())) > len(journal.batches(spark, root))
    assert not journal.append(spark.createDataFrame([("x", 1)], "k string, t long"), root, 0)
    assert journal.read(spark, root).count() == len(want)
