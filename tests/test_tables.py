"""Committed batch tables, the key index and the queue table."""

import os
import tempfile

from pyspark.sql import functions as F, types as T

from pagemill.schema import QUEUE, conform
from pagemill.sources.batches import BatchTable, newest, retain
from pagemill.sources import key_index
from pagemill.sources.key_index import KeyIndex
from pagemill.sources.queue_table import QueueTable

ONE = T.StructType([T.StructField("x", T.LongType())])


def folder():
    return tempfile.mkdtemp(prefix="pm-table-")


def xs(df):
    return sorted(r.x for r in df.collect())


def test_commit_is_what_readers_see(spark):
    t = BatchTable(spark, folder(), ONE)
    assert xs(t.read()) == []
    t.write(0, spark.range(3).toDF("x"))
    dead = t.stage(1, spark.range(10, 12).toDF("x"))        # killed between write and commit
    assert xs(t.read()) == [0, 1, 2] and dead not in str(t.commits())
    t.write(1, spark.range(20, 22).toDF("x"))               # the replay
    t.write(0, spark.range(5, 7).toDF("x"))                 # a second try replaces the first
    assert xs(t.read()) == [5, 6, 20, 21]
    assert xs(t.read(before=1)) == [5, 6] and xs(t.read(since=1)) == [20, 21]
    t.drop(0)
    assert xs(t.read()) == [20, 21]


def test_retention_reads_and_keeps_whole_batches(spark):
    t = BatchTable(spark, folder(), ONE)
    for b in range(6):
        t.write(b, spark.range(10 * b, 10 * b + 10).toDF("x"), {"rows": 10})
    assert retain(t, 25) == [2, 1, 0]
    assert retain(t, 25) == []
    assert xs(newest(t, 25, "x")) == list(range(35, 60)) and xs(newest(t, 1000, "x")) == list(range(30, 60))


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_key_index_is_exact_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(key_index, "START_BITS", 64)        # filters fill up and are rebuilt
    index = KeyIndex(spark, folder(), buckets=16)
    held = set()
    for b in range(4):
        names = [f"k{b}-{i}" for i in range(300)] + [None, "again"]
        got = {r.key for r in index.known(keys(spark, names), b).collect()}
        assert got == held & set(names)
        index.add(b, keys(spark, names))
        held |= {n for n in names if n}
    assert {r.key for r in index.known(keys(spark, [f"k2-{i}" for i in range(9)] + ["new"])).collect()} == {f"k2-{i}" for i in range(9)}
    assert len(index.known(keys(spark, ["k0-0"])).collect()) == 1 and len(index.buckets_read) == 1
    fresh = keys(spark, [f"fresh{i}" for i in range(16)])
    assert index.known(fresh).count() == 0 and len(index.buckets_read) <= 4
    # a replayed batch neither sees nor doubles its first try
    assert {r.key for r in index.known(keys(spark, ["k3-0", "k2-0"]), 3).collect()} == {"k2-0"}
    index.add(3, keys(spark, ["k3-0"]))
    assert {r.key for r in index.known(keys(spark, ["k3-0", "k3-1"])).collect()} == {"k3-0"}


def items(spark, ids, status="pending", url=True):
    rows = [(i, 1, f"https://h.example/{i}" if url else None, status) for i in ids]
    return conform(spark.createDataFrame(rows, "queue_id long, rule_id long, url string, status string"), QUEUE)


def test_queue_table_folds_and_archives(spark):
    q = QueueTable(spark, folder())
    q.append(0, items(spark, range(10)))
    q.append(1, items(spark, [0, 1], "success", url=False))
    q.append(2, items(spark, [2], "failed"))
    want = {i: "pending" for i in range(10)} | {0: "success", 1: "success", 2: "failed"}
    state = lambda: {r.queue_id: r.status for r in q.state().collect()}
    assert state() == want
    q.compact(3)
    assert state() == want and {r.queue_id for r in q.open_items().collect()} == set(range(3, 10))
    assert q.state().where("url is null").count() == 0
    q.append(3, items(spark, [2]))                          # reopened
    q.append(4, items(spark, [5], "running"))
    assert state() == want | {2: "pending", 5: "running"}
    assert {r.queue_id for r in q.open_items(before=4).collect()} == set(range(2, 10))
    q.compact(5)
    assert state() == want | {2: "pending", 5: "running"}


def test_bytes_of_a_pass_stay_flat(spark):
    """Twenty batches of items that are all finished: a pass reads as much at the end as at the
    beginning, while the queue grows."""
    q = QueueTable(spark, folder())
    read = []
    for b in range(20):
        q.append(3 * b, items(spark, range(100 * b, 100 * b + 100)))
        read.append(q.bytes_of_pass())
        q.append(3 * b + 1, items(spark, range(100 * b, 100 * b + 100), "success"))
        q.compact(3 * b + 2)
    assert max(read[1:]) < 1.3 * min(read[1:])
    assert q.state().count() == 2000 and q.open_items().count() == 0


def test_tables_live_beside_other_files(spark):
    """Readers of the plain folder skip commits and key folders."""
    base = folder()
    t = BatchTable(spark, base, ONE)
    t.write(0, spark.range(3).toDF("x"))
    KeyIndex(spark, os.path.join(base, "_keys")).add(0, keys(spark, ["a"]))
    assert xs(spark.read.parquet(base).select(F.col("x"))) == [0, 1, 2]
