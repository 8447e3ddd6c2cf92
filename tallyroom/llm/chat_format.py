"""Chat formatting by event sourcing, in DataFrame functions only.

A conversation is a log of events.  The log is dealt by conversation, sorted by sequence and folded: ``open`` begins a
message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties it so that deltas can follow.  The
messages are rendered with a template whose control strings can't occur in a text, because texts are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: turn = BEGIN role SEP text END.  Texts have no MARK left: it is escaped, and so are brackets and </s>.
MARK = "\\"
BEGIN, SEP, END = "[INST:", "]\n", "</s>\n"
#: (in a text, in the rendered form); MARK first, so that the reverse is unique.
ESCAPES = [(MARK, MARK + "m"), ("[", MARK + "b"), ("]", MARK + "c"), ("</s>", MARK + "e")]


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    """Reads the escapes back; MARK last, as nothing else makes one."""
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def folded(events: DataFrame, *, conversation: str = "conv_id", sequence: str = "seq", message: str = "msg", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, messages: array of (msg, role, text) in order): the state after the whole log.

    Events of equal sequence come in the order of kind (open, regenerate, edit, delta), then text.  A message's role is
    that of its first event that has one, a null role otherwise empty; its text is what the last open, edit or
    regenerate set, and the deltas since.  Null texts are empty.  Unknown kinds count as delta.  Messages of no (a null)
    conversation are a conversation each, so they gather nowhere.  Messages come by the sequence of their first event,
    then role, text and id.  One conversation is one row, so its log is in one task.
    """
    rank = F.coalesce(F.when(F.col(kind) == "open", 0).when(F.col(kind) == "regenerate", 1).when(F.col(kind) == "edit", 2), F.lit(3))
    log = events.select(
        F.col(conversation).alias("conv"), F.col(message).alias("msg"),
        F.struct(F.col(sequence).alias("seq"), rank.alias("rank"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(role).alias("role")).alias("event"),
    )
    # dealt once by conversation: messages and conversations are then grouped where they lie
    alone = F.when(F.col("conv").isNull(), F.xxhash64("msg"))
    by_message = log.withColumn("alone", alone).repartition("conv", "alone").groupBy("conv", "alone", "msg").agg(F.sort_array(F.collect_list("event")).alias("log"))

    def state(log: Column) -> Column:
        resets = F.transform(log, lambda e, i: F.when(e["rank"] < 3, i))
        since = F.greatest(F.lit(0), F.coalesce(F.array_max(resets), F.lit(0)))
        return F.array_join(F.transform(F.slice(log, since + 1, F.size(log)), lambda e: F.when(e["rank"] == 1, "").otherwise(e["text"])), "")

    first_role = F.coalesce(F.get(F.filter(F.transform(F.col("log"), lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit(""))
    messages = by_message.select("conv", "alone", F.struct(F.col("log")[0]["seq"].alias("seq"), first_role.alias("role"), state(F.col("log")).alias("text"), "msg").alias("message"))
    whole = messages.groupBy("conv", "alone").agg(F.sort_array(F.collect_list("message")).alias("messages"))
    return whole.select(F.col("conv").alias(conversation), F.transform("messages", lambda m: F.struct(m["msg"].alias("msg"), m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def rendered(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """The columns, then formatted: all turns in the template."""
    turn = lambda m: F.concat(F.lit(BEGIN), escaped(m["role"]), F.lit(SEP), escaped(m["text"]), F.lit(END))
    return conversations.withColumn("formatted", F.array_join(F.transform(messages, turn), ""))


def read_back(formatted: Column) -> Column:
    """Array of (role, text), from the rendered form alone."""
    turns = F.filter(F.split(formatted, "\\[INST:"), lambda t: t != "")

    def parts(turn: Column) -> Column:
        at = F.instr(turn, SEP)
        body = F.substring(turn, at + len(SEP), F.length(turn) - at - len(SEP) + 1 - len(END))
        return F.struct(unescaped(F.substring(turn, F.lit(1), at - 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, parts)


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Array of (start, length) in code points of the rendered form: what the loss is taken over, the texts of a role."""
    turns = F.filter(F.split(formatted, "\\[INST:"), lambda t: t != "")

    def step(acc: Column, turn: Column) -> Column:
        head = F.instr(turn, SEP) + len(SEP) - 1
        span = F.struct((acc["at"] + len(BEGIN) + head + 1).alias("start"), (F.length(turn) - head - len(END)).alias("length"))
        mine = F.substring(turn, F.lit(1), F.instr(turn, SEP) - 1) == role
        return F.struct((acc["at"] + len(BEGIN) + F.length(turn)).alias("at"), F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_conversations(events: DataFrame, **columns) -> DataFrame:
    """(conversation, messages, formatted, loss_spans) of an event log; see ``folded`` for the defined cases."""
    out = rendered(folded(events, **columns))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted")))


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Counts and hashes of what is read back from the rendered form and its loss mask."""

    def masked(text: Column) -> Column:
        return F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(text, s["start"], s["length"]))), "")

    read = formatted.select(conversation, F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted")).alias("loss"))
    return read.select(
        conversation, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
