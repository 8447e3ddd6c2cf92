"""Trie of conversations' prefixes with sums over subtrees, by heavy-path decomposition.

A node is a sequence of first turns; it is named by two 64-bit hashes, each the exclusive or of its turns' hashes at
their places, so a conversation's nodes are a running fold.  A node's heavy child has the most members; heavy children
chain nodes to paths, each of which ends at a leaf and is found along the leaf's smallest conversation, without pointer
jumping.  A root path crosses at most log2(members) light edges, so the decomposition has so many levels: from the deepest
level on, each path is an array along which values are summed from its end (suffix sums), and its total is attached to
the parent of its top, on a path of the level before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import bound_batches, written
from tallyroom.llm.components import HUBS, with_key_values

#: Turns of a conversation, and nodes of a path, that are scanned together; longer ones are scanned in blocks.
BLOCK = 4096
NODE, PARENT = ["a", "b"], ["up_a", "up_b"]
EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, place: Column, order: list[str], values: dict[str, str], fold: Callable, join: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows (conv, ...) with a fold of columns over each conversation's rows up to each.  values: column to result.

    Blocks of ``place`` (which grows with the order) are scanned apart and joined by what came before each: a
    conversation with a third of all rows is scanned by many tasks.
    """
    blocks = rows.withColumn("__block", F.coalesce(F.shiftright(place, BLOCK.bit_length() - 1), F.lit(-(1 << 62))))
    totals = blocks.groupBy("conv", "__block").agg(*[fold(v).alias(f"__{v}") for v in values])
    earlier = Window.partitionBy("conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv", "__block", *[F.coalesce(fold(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    within = Window.partitionBy("conv", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = blocks.select("*", *[fold(v).over(within).alias(f"__in_{v}") for v in values]).join(before, ["conv", "__block"])
    return scanned.select(*rows.columns, *[join(F.col(f"__in_{v}"), F.col(f"__{v}")).alias(as_) for v, as_ in values.items()])


def placed_turns(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place from 1, key, n_bytes): turns by number, nulls first, then role and the text's SHA-256.

    Null roles and texts are empty, rows of no conversation are left out.  key tells role and text apart; no text is
    shuffled.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    light = rows.where(F.col(f"`{conversation}`").isNotNull()).select(
        F.col(f"`{conversation}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), said(role).alias("role"),
        F.sha2(said(text), 256).alias("text"), F.octet_length(said(text)).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"),
    )
    placed = running(light, F.col("turn"), ["turn", "role", "text"], {"one": "place"}, F.sum, lambda x, y: x + y)
    return placed.select("conv", "place", F.sha2(F.concat_ws("\n", "text", "role"), 256).alias("key"), "n_bytes")


def members(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv, depth, a, b, up_a, up_b, n_bytes): the nodes that each conversation passes, the root among them."""
    named = turns.select("conv", "place", "n_bytes", *[F.xxhash64(F.lit(k), "key", "place").alias(f"own_{c}") for k, c in enumerate(NODE)])
    chain = running(named, F.col("place") - 1, ["place"], {"own_a": "a", "own_b": "b"}, F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    nodes = chain.select("conv", F.col("place").alias("depth"), *NODE, *[F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"up_{c}") for c in NODE], "n_bytes")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.select("conv", zero.alias("depth"), *[zero.alias(c) for c in NODE], *[none.alias(c) for c in PARENT], zero.alias("n_bytes"))
    return nodes.unionByName(root)


def flagged_nodes(chains: DataFrame) -> DataFrame:
    """A row a node: conv_id (its smallest member), parent_conv_id, n_convs, n_children, light (no heavy child, or the root)."""
    nodes = chains.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ["depth", "n_bytes", *PARENT]])
    nodes = written(nodes)
    # children of a node have no member in common, so the smallest member tells them apart
    heavy = F.bitwise_not(F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("c")))["c"]).alias("heavy")
    families = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children"), heavy)
    families = families.select(*[F.col(p).alias(c) for p, c in zip(PARENT, NODE, strict=True)], "n_children", "heavy")
    whole = written(nodes.join(families, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = whole.where("n_children > 0").select(*[F.col(c).alias(p) for p, c in zip(PARENT, NODE, strict=True)], F.col("n_children").alias("n"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    plain = whole.drop("heavy")
    below = with_key_values(plain.where("depth > 0"), parents, PARENT, max(64, whole.count() // HUBS))
    below = below.withColumn("light", F.col("conv_id") != F.col("chosen")).drop("chosen")
    root = plain.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "light": F.lit(True)})
    return written(below.unionByName(root))


def on_paths(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with path (the smallest conversation of the leaf at its end), top (its first depth) and level (light edges above it).

    Along the conversation that a leaf is named by, the path of the leaf begins at the last light node.  Every node is
    on one path, so rows that lie above the path of their conversation are dropped.
    """
    degree = max(64, chains.count() // HUBS)
    flags = nodes.withColumn("n", F.col("n_convs")).drop("depth", "n_bytes", *PARENT)
    passed = written(with_key_values(chains, flags, NODE, degree))
    tops = passed.groupBy("conv").agg(
        F.max(F.when(F.col("light"), F.col("depth"))).alias("top"), (F.count_if("light") - 1).alias("level"),
        F.bool_or((F.col("n_children") == 0) & (F.col("conv_id") == F.col("conv"))).alias("named"), F.count("*").alias("n"),
    )
    found = with_key_values(passed, written(tops.where("named").drop("named")), "conv", degree).where("depth >= top")
    return found.withColumnRenamed("conv", "path").drop("light")


def suffix_sums(rows: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """The rows (path, depth, ...) with ``sums`` replaced by sums over the path from each row to its end.

    A path's rows are an array, in blocks of BLOCK; what later blocks hold is added where there are any.
    """
    shift = BLOCK.bit_length() - 1
    others = [c for c in rows.columns if c not in ("depth", *sums)]
    entry = F.struct("depth", *sums, *others)
    arrays = rows.groupBy("path", F.shiftright("depth", shift).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("line"))
    schema = rows.select("depth", *sums, *others).schema
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0)
            flat = lines.flatten()
            ends = np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            which = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            columns = dict(zip(schema.names, flat.flatten(), strict=True))
            for name in sums:
                upto = np.cumsum(columns[name].to_numpy(zero_copy_only=False).astype(np.int64))
                own = np.diff(upto, prepend=0)
                columns[name] = pa.array((upto[ends - 1][which] if len(ends) else upto) - upto + own)
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    summed = arrays.select("line").mapInArrow(run, schema)
    if deepest < BLOCK:
        return summed
    summed = written(summed.withColumn("block", F.shiftright("depth", shift)))
    totals = summed.groupBy("path", "block").agg(*[F.max_by(s, -F.col("depth")).alias(s) for s in sums])
    later = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("path", "block", *[F.coalesce(F.sum(s).over(later), F.lit(0)).alias(f"__{s}") for s in sums])
    joined = summed.join(carried, ["path", "block"])
    return joined.select("depth", *[(F.col(s) + F.col(f"__{s}")).alias(s) for s in sums], *others)


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """The nodes of ``on_paths`` with each of ``sums`` replaced by its sum over the node's subtree; one round a level."""
    nodes = written(nodes, by="level")
    levels, deepest = nodes.agg(F.max("level"), F.max("depth")).first()
    done, attached = [], None
    for level in range(-1 if levels is None else levels, -1, -1):
        here = nodes.where(F.col("level") == level)
        if attached is not None:
            here = here.join(attached, NODE, "left").withColumns({s: F.col(s) + F.coalesce(f"more_{s}", F.lit(0)) for s in sums}).select(*nodes.columns)
        here = written(suffix_sums(here, sums, deepest))
        done.append(here)
        # totals of light paths, one row a parent however many there are
        tops = here.where("depth = top").groupBy(*PARENT).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        attached = tops.select(*[F.col(p).alias(c) for p, c in zip(PARENT, NODE, strict=True)], *[f"more_{s}" for s in sums])
    if not done:
        return nodes
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def end_digests(chains: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the conversations that end at a node, ascending, joined by commas.

    Ids are joined in groups of at most 1,024 before a node's are brought together; these stream through their task.
    """
    ends = chains.groupBy("conv").agg(*[F.max_by(c, "depth").alias(c) for c in NODE])
    parts = ends.groupBy(*NODE, F.shiftright("conv", 10).alias("part")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    dealt = parts.select(*NODE, "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def told(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "ends_sha256"])

        for batch in batches:
            out = []
            for a, b, ids in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if node == (a, b):
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (a, b), hashlib.sha256()
                digest.update(ids.encode())
            yield told(out)
        if node is not None:
            yield told([(*node, digest.hexdigest())])

    return dealt.select(*NODE, "ids").mapInArrow(run, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie of conversations: a row a node, the root included if there is any conversation.

    turns: (conv, place from 1 without gaps, key, n_bytes), as ``placed_turns`` gives them.  ids: (conv), each once; a
    conversation without turns ends at the root.  Returns conv_id (smallest member), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, members
    but one times the last text's bytes) and ends_sha256.  No conversations: no rows.
    """
    chains = written(members(turns, ids))
    nodes = on_paths(chains, flagged_nodes(chains))
    valued = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    sums = subtree_sums(valued.drop("n_bytes"), ["n_leaves", "saved_tokens"])
    out = sums.join(end_digests(chains), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def trie_of(rows: DataFrame, conversation: str = "conv_id", **columns: str) -> DataFrame:
    """The trie of a table of turns; its rows' conversations are its members.  See ``placed_turns`` and ``prefix_trie``."""
    turns = written(placed_turns(rows, conversation, **columns))
    return prefix_trie(turns, turns.select("conv").distinct())


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of the query: each conversation c takes the first h turns of c - c % 5, then its own after its first h.

    h: crc32 of c as text, modulo 9.  ``%`` keeps the sign of c.  turns: a written table.
    """
    cut = lambda c: F.crc32(c.cast("string").cast("binary")) % 9
    base = lambda c: c - c % 5
    lengths = written(turns.groupBy("conv").agg(F.max("place").alias("n")))
    of_base = lengths.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    known = lengths.withColumn("base", base(F.col("conv"))).join(of_base, "base", "left")
    known = written(known.select("conv", "n", F.least(cut(F.col("conv")), F.coalesce("n_base", F.lit(0))).alias("taken")))
    rest = with_key_values(turns.where(F.col("place") > cut(F.col("conv"))), known, "conv", max(64, turns.count() // HUBS))
    own = rest.select("conv", (F.col("place") - cut(F.col("conv")) + F.col("taken")).alias("place"), "key", "n_bytes")
    first = turns.where((F.col("place") <= 8) & (F.col("conv") % 5 == 0))
    near = F.filter(F.sequence(F.col("conv") - 4, F.col("conv") + 4), lambda c: base(c) == F.col("conv"))
    heads = first.select(F.explode(near).alias("conv"), "place", "key", "n_bytes").where(F.col("place") <= cut(F.col("conv"))).join(known.select("conv"), "conv")
    return own.unionByName(heads), known.select("conv")
