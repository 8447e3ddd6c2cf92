"""An outbox: saves wait until they are sent, at least once, and are taken only on the revision that they are based on.

Two tables of a store: ``pending`` holds an owner's last unsent save (whole, so an older one is replaced), ``remote``
what is stored and its revision.  Queueing, sending and the note that a batch counted are one change of the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.sources.store import Store, Transaction

PENDING = "owner long, revision long, base long, conflict boolean, payload string"
REMOTE = "owner long, revision long, payload string"


def open_outbox(store: Store, buckets: int = 16) -> None:
    def change(tx: Transaction) -> None:
        tx.create("pending", PENDING, ["owner"], buckets)
        tx.create("remote", REMOTE, ["owner"], buckets)

    store.transact(change)


def queued(saves: DataFrame, pending: DataFrame, remote: DataFrame) -> DataFrame:
    """The pending rows after saves (owner, at, base, payload): an owner's last save by ``at``, then payload, stays.

    revision counts an owner's saves since it was last empty.  base: that of the save; if null that of the row that it
    replaces, else the remote revision.  A conflict stays until it is resolved.
    """
    last = saves.where("owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("n"), F.max_by(F.struct("base", "payload"), F.struct("at", "payload")).alias("s"))
    held = pending.select("owner", F.col("revision").alias("r0"), F.col("base").alias("b0"), F.col("conflict").alias("c0"))
    known = remote.select("owner", F.col("revision").alias("stored"))
    rows = last.join(held, "owner", "left").join(known, "owner", "left")
    return rows.select(
        "owner", (F.coalesce("r0", F.lit(0)) + F.col("n")).alias("revision"), F.coalesce("s.base", "b0", "stored").alias("base"),
        F.coalesce("c0", F.lit(False)).alias("conflict"), F.col("s.payload").alias("payload"),
    )


def _send(tx: Transaction, rows: DataFrame, offline: bool) -> None:
    """Compare and set: what is based on the stored revision is stored as the next one and leaves; the rest is in conflict."""
    if offline:
        tx.upsert("pending", rows, ["revision"])
        return
    known = tx.read("remote").select("owner", F.col("revision").alias("stored"))
    tried = rows.join(known, "owner", "left").withColumn("fits", ~F.col("conflict") & F.col("base").eqNullSafe(F.col("stored")))
    taken = tried.where("fits").select("owner", (F.coalesce("stored", F.lit(0)) + 1).alias("revision"), "payload")
    left = tried.select("owner", "revision", "base", F.lit(True).alias("conflict"), "payload", "fits")
    tx.upsert("remote", taken, ["revision"])
    tx.upsert("pending", left, ["revision"], gone="fits")


def outbox_into(store: Store, writer: str, offline: Callable[[int], bool] = lambda batch: False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for saves (owner, at, base, payload).  A batch that comes again counts once.

    While ``offline(batch)`` saves only queue; the next batch sends all that waits.
    """

    def put(saves: DataFrame, batch: int) -> None:
        def change(tx: Transaction) -> None:
            pending = tx.read("pending")
            new = queued(saves, pending, tx.read("remote"))
            waiting = pending.join(new.select("owner"), "owner", "left_anti").where("NOT conflict")
            _send(tx, new.unionByName(waiting), offline(batch))

        store.transact(change, writer, batch)

    return put


def resolve(store: Store, choices: DataFrame) -> None:
    """Of owners in conflict, choices (owner, payload) are sent on the stored revision; others' choices are passed over."""

    def change(tx: Transaction) -> None:
        stuck = tx.read("pending").where("conflict").select("owner", "revision")
        known = tx.read("remote").select("owner", F.col("revision").alias("base"))
        chosen = choices.groupBy("owner").agg(F.max("payload").alias("payload")).join(stuck, "owner").join(known, "owner", "left")
        _send(tx, chosen.select("owner", (F.col("revision") + 1).alias("revision"), "base", F.lit(False).alias("conflict"), "payload"), False)

    store.transact(change)


def status(store: Store) -> DataFrame:
    """(owner, status, stored, revision): conflict, pending, or stored where nothing waits."""
    tx = store.transaction()
    remote = tx.read("remote").select("owner", F.col("revision").alias("stored"), F.col("payload").alias("stored_payload"))
    both = tx.read("pending").join(remote, "owner", "full")
    word = F.when(F.col("conflict"), "conflict").when(F.col("revision").isNotNull(), "pending").otherwise("stored")
    return both.select("owner", word.alias("status"), "stored", "stored_payload", "revision", "payload")
