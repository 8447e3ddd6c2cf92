"""Stores and outboxes: whole tables after failures, one writer a version, batches that count once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyroom.sources import store as st
from tallyroom.streaming import outbox as ob


@pytest.fixture
def store(spark, tmp_path):
    out = st.Store(spark, f"file://{tmp_path}/store")
    out.transact(lambda tx: tx.create("facts", "k long, v long, at long", ["k"], 4))
    return out


def facts(spark, n, v, at=0, parts=4):
    return spark.range(n, numPartitions=parts).select(F.col("id").alias("k"), F.lit(v).cast("long").alias("v"), F.lit(at).cast("long").alias("at"))


def values(store, version=None):
    return sorted(map(tuple, store.read("facts", version).collect()))


def test_a_writer_that_fails_between_tasks_leaves_the_old_table(spark, store):
    store.transact(lambda tx: tx.append("facts", facts(spark, 50, 1)))
    before, versions = values(store), store.versions()
    burst = facts(spark, 50, 2, 1).withColumn("v", F.when(F.col("k") == 40, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    for change in (lambda tx: tx.upsert("facts", burst, ["at"]), lambda tx: tx.append("facts", burst), lambda tx: tx.replace("facts", burst)):
        with pytest.raises(Exception, match="killed"):
            store.transact(change)
    assert values(store) == before and store.versions() == versions


def test_a_writer_that_dies_before_its_manifest_leaves_the_old_table(spark, store, monkeypatch):
    store.transact(lambda tx: tx.append("facts", facts(spark, 10, 1)))

    def die(*_):
        raise SystemExit("gone")

    with monkeypatch.context() as m:
        m.setattr(st.Store, "_publish", die)
        with pytest.raises(SystemExit):
            store.transact(lambda tx: tx.replace("facts", facts(spark, 3, 9)))
    assert values(store) == [(k, 1, 0) for k in range(10)]
    assert store.vacuum(1) == 1  # what the dead writer had written
    assert values(store) == [(k, 1, 0) for k in range(10)]


def test_the_second_of_two_writers_starts_again(spark, store):
    seen = []

    def change(tx):
        seen.append(tx.version)
        if len(seen) == 1:  # another one comes in between
            store.transact(lambda other: other.append("facts", facts(spark, 3, 1)))
        n = tx.read("facts").count()
        tx.append("facts", spark.createDataFrame([(100, n, 0)], "k long, v long, at long"))

    assert store.transact(change)
    assert seen == [1, 2] and values(store) == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (100, 3, 0)]
    late = store.transaction(1)
    late.append("facts", facts(spark, 1, 7))
    with pytest.raises(st.Conflict):
        store._publish(late.version + 1, late.manifest)


def test_upserts_and_versions(spark, store):
    store.transact(lambda tx: tx.append("facts", facts(spark, 6, 1, 5)))
    rows = spark.createDataFrame([(0, 2, 4, False), (1, 2, 5, False), (2, 2, 6, True), (9, 2, 0, False), (9, 3, 1, False)], "k long, v long, at long, gone boolean")
    files = lambda: store.transaction().manifest["tables"]["facts"]["files"]
    before = files()
    store.transact(lambda tx: tx.upsert("facts", rows.where("k = 1"), ["at"], gone="gone"))
    assert sum(files().get(b) != f for b, f in before.items()) == 1  # one bucket alone is written again
    store.transact(lambda tx: tx.upsert("facts", rows, ["at"], gone="gone"))
    assert values(store) == [(0, 1, 5), (1, 2, 5), (3, 1, 5), (4, 1, 5), (5, 1, 5), (9, 3, 1)]
    assert values(store, 2) == [(k, 1, 5) for k in range(6)]
    store.transact(lambda tx: tx.upsert("facts", rows.limit(0), ["at"], gone="gone"))
    assert len(values(store)) == 6


def test_a_batch_counts_once(spark, store, tmp_path):
    facts(spark, 20, 1, parts=1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, v long, at long").parquet(f"{tmp_path}/in")
    put = lambda df, batch: store.transact(lambda tx: tx.append("facts", df), "stream", batch)

    def twice(df, batch):
        assert put(df, batch) and not put(df, batch)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(values(store)) == 20
    assert not put(facts(spark, 5, 1), 0)


def told(store):
    return {r.owner: (r.status, r.stored, r.stored_payload, r.revision, r.payload) for r in ob.status(store).collect()}


def test_outbox(spark, tmp_path):
    box = st.Store(spark, f"file://{tmp_path}/box")
    ob.open_outbox(box, 4)
    saves = lambda *rows: spark.createDataFrame(list(rows), "owner long, at long, base long, payload string")
    put = ob.outbox_into(box, "saves", offline=lambda batch: batch == 1)
    put(saves((1, 1, None, "a"), (1, 2, None, "b"), (2, 1, 7, "c"), (None, 1, None, "x")), 0)
    assert told(box) == {1: ("stored", 1, "b", None, None), 2: ("conflict", None, None, 1, "c")}
    put(saves((1, 3, 1, "d"), (3, 3, None, "e")), 1)  # no network
    assert told(box)[1] == ("pending", 1, "b", 1, "d") and told(box)[3] == ("pending", None, None, 1, "e")
    put(saves((2, 4, None, "f"), (1, 4, None, "g")), 2)  # a conflict stays, what waited is sent
    want = {1: ("stored", 2, "g", None, None), 2: ("conflict", None, None, 2, "f"), 3: ("stored", 1, "e", None, None)}
    assert told(box) == want
    put(saves((2, 4, None, "z"), (1, 4, None, "z")), 2)  # the batch comes again
    assert told(box) == want
    ob.resolve(box, spark.createDataFrame([(2, "mine"), (3, "not stuck")], "owner long, payload string"))
    assert told(box) == want | {2: ("stored", 1, "mine", None, None)}
    put(saves((1, 5, 1, "late")), 3)  # based on a revision that is gone
    assert told(box)[1] == ("conflict", 2, "g", 1, "late")
