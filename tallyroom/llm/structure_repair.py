"""Repair of conversations' turn structure at the least cost: a dynamic programme over tensors whose first axis is time.

A repaired conversation is empty, or an optional system turn before pairs of a user and an assistant turn.  Turns may be
kept, given another role, deleted, and empty ones inserted.  Where a conversation stands in that form is one of four
states; the next role that may be inserted follows from the state.  Within a task conversations are put in buckets of
like length; of a bucket, costs from the end backwards are arrays (time, conversation, state), filled for all its
conversations at once, turn by turn, and edits are read off forwards, again for all at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm.common import crc_remainder, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Of a turn's role initial: system, user, assistant, any other.  Of a turn: sound, truncated, to be deleted.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, CUT, GONE = range(3)
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state after a turn of the role that is due (a user's, but after a user's an assistant's).
DUE = np.array([AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER])
#: The state after keeping a turn, by state and initial; -1 where it can't be kept.
KEPT = np.array([[AFTER_SYSTEM, AFTER_USER, -1, -1], [-1, AFTER_USER, -1, -1], [-1, -1, AFTER_ASSISTANT, -1], [-1, AFTER_USER, -1, -1]])
NEVER = 1 << 30
#: Cells (time, conversation, state) of a bucket that is worked off; a single longer conversation is a bucket of its own.
CELLS = 1 << 21
#: In the order of the alphabet, which settles ties.
D, I, K, R, STOP = (ord(c) for c in "DIKR\0")

WHITE = " \t\n\v\f\r"


def backward_costs(codes: np.ndarray) -> np.ndarray:
    """Costs (time + 1, conversation, state) of the rest from each turn on; codes (time, conversation): initial + 4 * fault, -1 past the end.

    Past its end a conversation costs what its state still needs: nothing, or the turns due.  Inserts are followed over
    at most two turns: a third comes back to where the first led.
    """
    steps, n = codes.shape
    costs = np.empty((steps + 1, n, 4), np.int32)
    at_end = np.array([0, 2 * INSERT, INSERT, 0], np.int32)
    costs[steps] = at_end
    for t in range(steps - 1, -1, -1):
        code, after = codes[t], costs[t + 1]
        best = np.minimum(_delete(after), np.minimum(_keep(code, after), _rerole(code, after)))
        for _ in range(2):
            best = np.minimum(best, best[:, DUE] + INSERT)
        costs[t] = np.where((code < 0)[:, None], at_end, best)
    return costs


def _delete(after: np.ndarray) -> np.ndarray:
    return after + DELETE


def _keep(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    to = KEPT[:, code & 3].T
    cost = np.take_along_axis(after, np.maximum(to, 0), 1) + (KEEP + TRUNCATED * (code >> 2 == CUT))[:, None]
    return np.where((to < 0) | (code >> 2 == GONE)[:, None], NEVER, cost)


def _rerole(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    cost = after[:, DUE] + (REROLE + TRUNCATED * (code >> 2 == CUT))[:, None]
    return np.where((code >> 2 == GONE)[:, None], NEVER, cost)


def trace(codes: np.ndarray, costs: np.ndarray) -> list[str]:
    """For each conversation the least string of initials (Delete, Insert, Keep, Rerole) among its cheapest edits.

    Each round every conversation that isn't done takes the first edit of the alphabet that stays on a cheapest way.
    An edit settles the state after it, so the first differing sign of two ways decides, and this is the least string.
    """
    steps, n = codes.shape
    padded = np.vstack([codes, np.full((1, n), -1, codes.dtype)])
    at, state, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    while len(live):
        t, s, code = at[live], state[live], padded[at[live], live].astype(np.int64)
        rest, now, over = costs[np.minimum(t + 1, steps), live], costs[t, live, s], code < 0
        rows = np.arange(len(live))
        inserted = costs[t, live, DUE[s]] + INSERT == now
        deleted, kept = _delete(rest)[rows, s] == now, _keep(np.maximum(code, 0), rest)[rows, s] == now
        edit = np.where(over, np.where(inserted & (now > 0), I, STOP), np.where(deleted, D, np.where(inserted, I, np.where(kept, K, R))))
        going = edit != STOP
        who.append(live[going])
        what.append(edit[going].astype(np.uint8))
        state[live] = np.select([edit == D, edit == K, going], [s, KEPT[s, np.maximum(code, 0) & 3], DUE[s]], s)
        at[live] = t + (going & (edit != I))
        live = live[going]
    owners, edits = np.concatenate(who), np.concatenate(what)
    cuts = np.cumsum(np.bincount(owners, minlength=n))[:-1]
    return [part.tobytes().decode() for part in np.split(edits[np.argsort(owners, kind="stable")], cuts)]


def repair_bucket(codes: list[bytes]) -> list[tuple[int, str]]:
    """(cost, edits) of conversations given as one byte a turn (initial + 4 * fault), padded to the longest."""
    if not codes:
        return []
    steps = max(map(len, codes))
    table = np.full((steps, len(codes)), -1, np.int8)
    for k, c in enumerate(codes):
        table[: len(c), k] = np.frombuffer(c, np.int8)
    costs = backward_costs(table)
    return list(zip(costs[0, :, START].tolist(), trace(table, costs), strict=True))


def turn_faults(text: Column) -> Column:
    """blank, truncated or null: whether a text has no sign but white space, and else whether its last is no ``.!?``."""
    last = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


ORDER = ["conv", "turn", "role", "key"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDITED = T.StructType([T.StructField("conv", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])


def audited(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of turns (conv, turn, role, key, fault, again).

    Turns are dealt by conversation and read in order, so of a conversation a task holds one byte a turn, which is no
    more than the audit that it returns.
    """
    initial = _initial(F.col("role"))
    fault = F.when(F.col("fault") == "blank", "b").when(F.col("again"), "d").when(F.col("fault") == "truncated", "t").otherwise("")
    kind = F.when(fault.isin("b", "d"), GONE).when(fault == "t", CUT).otherwise(SOUND)
    dealt = turns.select(*ORDER, (initial + 4 * kind).cast("int").alias("code"), fault.alias("fault"), "again").repartition("conv").sortWithinPartitions(*ORDER, "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list] = {}

        def put(conv: int, log: _Log) -> Iterator[pa.RecordBatch]:
            size = len(log.codes).bit_length()
            buckets.setdefault(size, []).append((conv, log))
            if len(buckets[size]) << size >= CELLS // 4:
                yield flush(buckets.pop(size))

        def flush(bucket: list) -> pa.RecordBatch:
            out = repair_bucket([bytes(log.codes) for _, log in bucket])
            rows = [(conv, *log.counts(), cost, audit) for (conv, log), (cost, audit) in zip(bucket, out, strict=True)]
            return _columns(rows, _AUDITED.names, [*[pa.int64()] * (len(COUNTS) + 1), pa.string()])

        conv, log = None, None
        for batch in batches:
            for c, turn, code, bad in zip(*[batch.column(batch.schema.names.index(x)).to_pylist() for x in ("conv", "turn", "code", "fault")], strict=True):
                if log is None or c != conv:
                    if log is not None:
                        yield from put(conv, log)
                    conv, log = c, _Log()
                log.add(turn, code, bad)
        if log is not None:
            yield from put(conv, log)
        for bucket in buckets.values():
            yield flush(bucket)

    return dealt.select("conv", "turn", "code", "fault").mapInArrow(run, _AUDITED)


class _Log:
    """What is counted of a conversation whose turns come in order."""

    def __init__(self) -> None:
        self.codes, self.faults, self.illegal, self.numbers, self.low, self.high = bytearray(), dict.fromkeys("bdt", 0), 0, 0, 0, -1

    def add(self, turn: int | None, code: int, fault: str) -> None:
        if self.codes and (self.codes[-1] & 3, code & 3) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        self.codes.append(code)
        if fault:
            self.faults[fault] += 1
        if turn is not None and (not self.numbers or turn != self.high):
            self.low = turn if not self.numbers else self.low
            self.high = turn
            self.numbers += 1

    def counts(self) -> tuple[int, ...]:
        return (self.high - self.low + 1 - self.numbers if self.numbers else 0, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal)


def repair_conversations(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ids: DataFrame | None = None, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(audits, turns): a row for each conversation, and the repaired turns (conversation, place, role, text), places from 0.

    audits: conversation, gaps (numbers missing between the least and the greatest turn), blank, duplicate, truncated
    (turns by their first fault: no sign but white space; role and text seen before; the last sign no ``.!?``), illegal
    (neighbours other than system-user, user-assistant, assistant-user by initials), cost and audit (initials of the
    cheapest edits in order; of equally cheap ones the least in ASCII).

    Keep costs 0, a new role 2, Delete 3, an Insert 2; blank and duplicate turns must go; a truncated one that stays
    adds 1.  Turns come by number, nulls first, then by role and the text's SHA-256.  Null roles and texts count as one
    space.  A role of another initial, or none, can't be kept.  Rows of no conversation are left out.
    ids: conversations (one column) that get a row even where rows have none of them: zeros and an empty audit.
    digests: instead of the repaired turns, (conversation, repaired_sha256): of ``role:text``, joined by line feeds.

    Texts go through one shuffle, for the repaired turns; the audit's rows hold hashes.  A conversation is a
    fold over its turns in order, in one task that holds one byte a turn of it, and none of its texts.
    """
    columns = [F.col(f"`{conversation}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]]
    keyed = rows.select(*columns).where("conv IS NOT NULL").withColumn("key", F.sha2("text", 256))
    light = keyed.select(*ORDER, turn_faults(F.col("text")).alias("fault"))
    # dealt by text, not by conversation: a long conversation is in many tasks here
    first = F.row_number().over(_by(["conv", "role", "key"], ["turn"])) > 1
    audits = audited(light.withColumn("again", first))
    if ids is not None:
        none = ids.select(F.col(f"`{ids.columns[0]}`").cast("long").alias("conv")).where("conv IS NOT NULL").distinct()
        none = none.select("conv", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"))
        whole = audits.unionByName(none).groupBy("conv")
        audits = whole.agg(*[F.max(c).alias(c) for c in COUNTS], F.max("audit").alias("audit"))
    audits = written(audits)
    plan = audits.select("conv", F.lit(True).alias("plan"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("key"), F.col("audit").alias("text"))
    both = keyed.withColumn("plan", F.lit(False)).unionByName(plan).repartition("conv")
    dealt = both.sortWithinPartitions("conv", F.col("plan").desc(), "turn", "role", "key").select("conv", "plan", "role", "text")
    made = dealt.mapInArrow(_digested, "conv long, repaired_sha256 string") if digests else dealt.mapInArrow(_turns, "conv long, place long, role string, text string")
    return audits.withColumnRenamed("conv", conversation), made.withColumnRenamed("conv", conversation)


def _by(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Batch by batch (conversation, place, role, text) of the turns that a conversation's audit makes of it.

    A conversation's audit comes before its turns and is told as place -1.
    """
    conv, plan, at, state, place = None, "", 0, START, 0
    for batch in batches:
        out: list[tuple] = []
        for c, is_plan, role, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            if is_plan:
                conv, plan, at, state, place = c, text, 0, START, 0
                out.append((conv, -1, "", ""))
            else:
                edit, at = plan[at], at + 1
                if edit == "R":
                    state = int(DUE[state])
                    role = "user" if state == AFTER_USER else "assistant"
                elif edit == "K":
                    state = int(KEPT[state, {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)])
                if edit != "D":
                    out.append((conv, place, role, text))
                    place += 1
            # what is inserted before the next turn
            while at < len(plan) and plan[at] == "I":
                state = int(DUE[state])
                out.append((conv, place, "user" if state == AFTER_USER else "assistant", ""))
                at, place = at + 1, place + 1
        yield out


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _edited(batches):
        yield _columns([r for r in rows if r[1] >= 0], ["conv", "place", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text``, joined by line feeds; texts stream, so that a conversation's are never together."""
    named = lambda rows: _columns(rows, ["conv", "repaired_sha256"], [pa.int64(), pa.string()])
    conv, digest = None, None
    for rows in _edited(batches):
        done = []
        for c, place, role, text in rows:
            if place < 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        yield named(done)
    if digest is not None:
        yield named([(conv, digest.hexdigest())])


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) as the repair's query damages them, by crc32 of ``conv_id:turn`` modulo 20.

    0: the row goes; 1: its text is emptied; 2: the text loses its ``.!?``; 3: the row comes twice; 4: its role is user.
    Null roles, texts and, in the hash, numbers are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    marked = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), crc_remainder(F.concat_ws(":", space("conv_id"), space("turn")), 20).alias("crc")).where("crc <> 0")
    text = F.when(F.col("crc") == 1, "").when(F.col("crc") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("crc") == 4, "user").otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("crc") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
