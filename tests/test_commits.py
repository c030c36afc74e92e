"""Tables behind a log of commits: whole versions, writers that meet, writers that die, buckets that stay."""

import threading

import pytest
from pyspark.sql import functions as F

from skeinlake.sources.commits import Conflict, Table, bucket_of


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t")


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k int, v int")


def held(table, **how):
    return sorted((r["k"], r["v"]) for r in table.read(**how).collect())


def test_versions_and_empty(spark, table):
    assert table.snapshot().version == -1
    for i in range(12):
        assert table.replace(rows(spark, [(k, i) for k in range(3)])) == 3
    assert table.snapshot().version == 11 and held(table) == [(k, 11) for k in range(3)]
    assert held(table, at=table.snapshot(4)) == [(k, 4) for k in range(3)]
    with pytest.raises(ValueError):
        table.snapshot(12)
    assert table.replace(table.read().select("k", (F.col("v") + 1).alias("v"))) == 3 and held(table) == [(k, 12) for k in range(3)]  # reads what it replaces
    table.replace(rows(spark, []))
    assert held(table) == []
    assert table.vacuum(versions=2, older=0) > 0 and held(table) == [] and held(table, at=table.snapshot(12)) == [(k, 12) for k in range(3)]


def test_upsert_rewrites_the_buckets_it_touches(spark, table):
    table.upsert(rows(spark, [(k, 0) for k in range(200)] + [(None, 7), (None, 7)]), "k", buckets=16)
    before = table.snapshot()
    after = table.upsert(rows(spark, [(3, 1), (3, 1), (500, 1)]), "k")
    touched = {bucket_of(f) for f in after.files - before.files}
    assert 1 <= len(touched) <= 2 and {f for f in before.files if bucket_of(f) not in touched} <= after.files
    assert not {f for f in before.files if bucket_of(f) in touched} & after.files
    some = {(r["k"], r["v"]) for r in table.read().collect()}
    assert some == {(k, 0) for k in range(200) if k != 3} | {(3, 1), (500, 1), (None, 7)} and table.read().count() == 203
    table.delete(rows(spark, [(3, 0), (9999, 0)]).select("k"), "k")
    assert table.read().where("k = 3").count() == 0 and table.read().count() == 202
    assert table.read(at=before).where("k = 3").collect()[0]["v"] == 0  # the old version is still whole


def test_writers_that_meet_lose_nothing(spark, table):
    table.upsert(rows(spark, [(-1, 0)]), "k", buckets=4)
    base = table.snapshot()
    table.commit(base, [], [], {})
    with pytest.raises(Conflict):
        table.commit(base, [], [], {})
    failed = []

    def work(i):
        try:
            for j in range(3):
                table.upsert(rows(spark, [(10 * i + j, i)]), "k")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and held(table) == sorted([(-1, 0)] + [(10 * i + j, i) for i in range(3) for j in range(3)])


def test_readers_see_whole_versions(spark, table):
    """A hundred commits while another thread reads: never a mixture, never an absent table."""
    table.replace(rows(spark, [(0, 0), (1, 0)]))
    stop, seen, failed = threading.Event(), set(), []

    def read():
        while not stop.is_set():
            try:
                got = held(table)
                assert len(got) == 2 and got[0][1] == got[1][1], got
                seen.add(got[0][1])
            except Exception as e:  # noqa: BLE001
                failed.append(e)
                return

    reader = threading.Thread(target=read)
    reader.start()
    base = table.snapshot()
    parts = [table.write(rows(spark, [(0, i), (1, i)]).coalesce(1), table.part(base)) for i in (1, 2)]
    for i in range(100):
        base = table.commit(base, parts[i % 2], list(base.files), {"rows": rows(spark, []).schema})
    stop.set()
    reader.join()
    assert not failed and seen <= {0, 1, 2} and table.snapshot().version == 100


@pytest.mark.parametrize("step", ["write", "count", "put", "link"])
def test_a_writer_that_dies_leaves_the_table(spark, table, monkeypatch, step):
    table.upsert(rows(spark, [(1, 1)]), "k", buckets=2)
    was = table.snapshot()

    class Death(Exception):
        pass

    def die(*_, **__):
        raise Death

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(Table, "write", die)
        elif step == "count":
            m.setattr(Table, "_written", die)  # files are there, uncounted
        elif step == "put":
            m.setattr(Table, "_put", die)
        else:
            put = Table._put
            m.setattr(Table, "_put", lambda self, name, text: put(self, "_log/.half", text[:5]) or die())  # half an entry, under no version's name
        with pytest.raises(Death):
            table.upsert(rows(spark, [(1, 2), (2, 2)]), "k")
    assert table.snapshot() == was and held(table) == [(1, 1)]
    table.upsert(rows(spark, [(2, 3)]), "k")
    assert held(table) == [(1, 1), (2, 3)]
