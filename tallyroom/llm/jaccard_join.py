"""N-gram Jaccard join by several global orders of the shingles.

Two sets with Jaccard similarity t share a token among the first n - ceil(t*n) + 1 of each, under any order that all
sets agree on.  The first order is the one that is dealt over the cluster: a fifth of all shingles (by hash) comes
before the rest, rare ones first, so texts that copy little have a prefix of shingles that nobody shares and drop out.
Texts tied by shared prefix shingles form clusters; where a cluster is too large for a task, a second order (all
shingles, rare ones first) cuts it again, and what is still too large is compared in blocks.  Within a cluster, pairs
must also share prefix shingles under two more hash orders before their whole sets are compared.

Links are only sought between sets that aren't connected yet, so a group of n near copies takes about n comparisons
and no pairs are ever rows; the components are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm.common import broadcast_if, discard, field, longs, map_texts, without, written
from tallyroom.llm.components import HUBS, connected_components, with_key_values

#: Of the first order: as many shingles lead as a prefix needs, times this; the commonest of them then stay behind it.
LEAD = 4 / 3
#: Sets and shingles that one task compares; larger clusters are cut.
BLOCK_SETS, BLOCK_SHINGLES = 2_000, 1_500_000
#: Rows that may be sent to all executors (8 bytes each); beyond, the same join is shuffled.
BROADCAST_ROWS = 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_WORDS_KEPT = 100_000


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values; each salt gives another order."""
    h = (h + _ODD[3] * np.uint64(salt)) * _ODD[0]
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    return h ^ (h >> np.uint64(32))


def shingler(size: int) -> Callable[[str | None], np.ndarray]:
    """From a text to the sorted distinct 64-bit hashes of its word shingles; fewer words make one shingle, none make none."""
    known: dict[bytes, int] = {}

    def shingles(text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > _WORDS_KEPT:
            known.clear()
        codes = np.fromiter([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64, len(words))
        n = min(size, len(codes))
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = mixed(h ^ codes[k : len(codes) - n + 1 + k])
        return np.unique(h)

    return shingles


def set_key(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A name of a set, of ``bits`` bits, and 64 bits more by which sets of one name are told apart."""
    whole = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(whole[:8], "little", signed=True) >> (64 - bits), int.from_bytes(whole[8:], "little", signed=True)


def clashes(rows: DataFrame) -> DataFrame | None:
    """(node, __clash) of the names that stand for more than one set among rows (node, check); None for none.

    Counted before they are joined; of n sets about n * n / 2 ** 65 names clash, so the list is short.
    """
    found = written(rows.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node", F.lit(True).alias("__clash")))
    return None if found.isEmpty() else found


def told_apart(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """The rows without check; where a name clashes, it becomes one of both hashes."""
    if clash is None:
        return rows.drop("check")
    named = rows.join(broadcast_if(clash, BROADCAST_ROWS), "node", "left")
    return named.withColumn("node", F.when(F.col("__clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("check", "__clash")


def prefix_length(n: np.ndarray | int, percent: int):
    """Of n tokens in any global order, so many that similar sets share one of them."""
    return n - -(-percent * n // 100) + 1


def prefix_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(node, cluster) of the sets that share a prefix token with another; all others are linked with nothing.

    sets: node; n, its size; lead, the tokens that come first in the order, rarest first, ties by value; n_lead, how
    many.  All other tokens come after them, by value; where those that lead are fewer than the prefix, lead is the
    whole prefix.
    """
    tokens = sets.select("node", F.explode("lead").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    found = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    # tokens that no other set has come first; what remains of the prefix is taken from the shared ones
    room = F.greatest(F.lit(0), F.col("p") - (F.col("n_lead") - F.size("found"))).cast("int")
    sizes = sets.select("node", "n_lead", (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1).alias("p"))
    prefixes = written(found.join(sizes, "node").select("node", F.explode(F.slice("found", F.lit(1), room)).alias("x")).select("node", F.col("x.token").alias("token")))
    centres = prefixes.groupBy("token").agg(F.min("node").alias("centre"), F.count("*").alias("k")).where("k > 1").drop("k")
    edges = prefixes.join(centres, "token").where("node <> centre").select("node", "centre").distinct()
    clusters = written(connected_components(edges, "node", "centre").withColumnRenamed("component", "cluster"))
    discard(prefixes)
    return clusters


def links_within(node: np.ndarray, label: np.ndarray, active: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all that links connect: between sets with different labels, one of each pair active."""
    m = len(node)
    size = np.fromiter(map(len, sets), np.int64, m)
    _, label = np.unique(label, return_inverse=True)
    need = prefix_length(size, percent)
    indexes = []
    for salt in (1, 2):
        first = []
        for s, p in zip(sets, need, strict=True):
            h = mixed(s, salt)
            first.append(np.partition(h, p - 1)[:p] if p < len(h) else h)
        tokens = np.concatenate(first)
        order = np.argsort(tokens, kind="stable")
        indexes.append((first, tokens[order], np.repeat(np.arange(m), [len(f) for f in first])[order]))
    found = []
    for x in np.flatnonzero(active)[np.argsort(size[np.flatnonzero(active)], kind="stable")]:
        near = (label != label[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
        for first, tokens, owner in indexes:
            if near.any():
                low, high = np.searchsorted(tokens, first[x], "left"), np.searchsorted(tokens, first[x], "right")
                seen = np.zeros(m, bool)
                counts = high - low
                seen[owner[np.repeat(high - np.cumsum(counts), counts) + np.arange(counts.sum())]] = True
                near &= seen
        todo = np.flatnonzero(near)
        while len(todo):
            some, todo = todo[:256], todo[256:]
            whole = np.concatenate([sets[y] for y in some])
            at = np.searchsorted(sets[x], whole)
            at[at == len(sets[x])] = 0
            both = np.add.reduceat((sets[x][at] == whole).astype(np.int64), np.r_[0, np.cumsum(size[some])[:-1]])
            for y in some[100 * both >= percent * (size[x] + size[some] - both)]:
                if label[y] != label[x]:
                    found.append((int(node[x]), int(node[y])))
                    label[label == label[y]] = label[x]
            todo = todo[label[todo] != label[x]]
    return found


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def block_links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) within each block of rows (node, label, active, tokens)."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in block["tokens"]]
        order = [np.sort(s) for s in sets]
        found = links_within(block["node"].to_numpy(), block["label"].to_numpy(), block["active"].to_numpy(), order, percent) if len(sets) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.select(*keys, "node", "label", "active", "tokens").groupBy(*keys).applyInPandas(compare, _EDGE)


def large_links(sets: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Links within clusters that no task can hold, compared in blocks.

    First each block with its cluster's first block, whose sets stand in for the group; then the sets outside the
    cluster's largest component so far, in blocks, with every block of the cluster.  Sets already connected aren't
    compared, so a group of copies of one text takes time in proportion to its size.
    """
    placed = written(sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    stand_in = placed.where(f"block = 0 AND pmod(xxhash64(node, 1), greatest(1, n_cluster div blocks * 8 div {block_sets})) = 0")
    stand_in = stand_in.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    rows = placed.unionByName(stand_in).withColumn("label", F.col("node")).withColumn("active", F.lit(True))
    first = written(block_links(rows, ["cluster", "block"], percent))
    named = placed.join(connected_components(first).withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("cluster", "label").count()
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    named = written(named.join(main, "cluster").withColumn("rest", F.col("label") != F.col("main")))
    rest = named.where("rest")
    # as few blocks of the rest as hold it
    n_rest = rest.groupBy("cluster").agg(F.ceil(F.count("*") / block_sets).cast("long").alias("rests"))
    rest = rest.join(n_rest, "cluster").withColumn("other", F.pmod(F.xxhash64("node", F.lit(7)), F.col("rests")))
    against = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("active", F.lit(True))
    against = against.select("cluster", "block", "other", "node", "label", "active", "tokens")
    every = named.join(n_rest, "cluster").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1))).withColumn("active", F.lit(False))
    # a set of the rest stands once in a block, as an active one
    every = every.where(~(F.col("rest") & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("rests")) == F.col("other"))))
    second = block_links(every.select(*against.columns).unionByName(against), ["cluster", "block", "other"], percent)
    return first.union(second)


def jaccard_components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, lead: float = LEAD, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, broadcast_rows: int = BROADCAST_ROWS, bits: int = 64
) -> DataFrame:
    """(key, n_shingles, component_id) for each row; component_id: the smallest key reachable by links, itself included.

    Words: runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of ``size`` words, or the
    whole sequence where there are fewer.  Rows link when 100 * intersection >= percent * union.  Null and empty texts
    have no shingles, link with nothing and keep their own key.  Rows with equal sets are one set (so repeated rows
    share a component); null keys are passed over by the smallest key unless there is no other.  Shingles are
    told apart by 64-bit hashes, sets by 128 bits: by a name of ``bits`` bits, and sets of one name by 64 more.  An empty
    table gives no rows.
    """
    sets_of = _make_sets(size, percent, -(-int(lead * (100 - percent) * 1000) // 1000), bits)
    table = written(map_texts(docs.select(key, text), text, [field("n", "long"), field("node", "long"), field("check", "long"), longs("lead")], sets_of, keep=[key]))
    clash = clashes(table.where("n > 0"))
    table = told_apart(table, clash)
    sets = table.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first(F.size("lead")).alias("n_lead"), F.first("lead").alias("lead"))
    clusters = prefix_clusters(sets, percent)
    rows = table.where("n > 0").select(F.col(key).alias("__key"), "node", "n")
    # combined first: a set that a third of all rows have is one row in the join
    holders = rows.groupBy("node").agg(F.min("__key").alias("__key"), F.first("n").alias("n")).join(clusters, "node").select("node", "cluster", "__key", "n")
    # sizes are joined to ids alone: no set is dealt by cluster before it is known that a task can hold the cluster
    holders = written(_sized(written(holders), block_sets, block_shingles))
    held = holders.select("__key").distinct()
    if holders.count() <= broadcast_rows:
        held = F.broadcast(held)
    texts = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    texts = texts.join(held, texts["__id"].eqNullSafe(held["__key"]), "left_semi")
    whole = map_texts(texts, "__text", [field("n", "long"), field("node", "long"), field("check", "long"), longs("tokens")], _make_sets(size, percent, 100, bits), keep=[])
    whole = told_apart(whole, clash)
    members = whole.join(holders.select("node", "cluster", "blocks", "n_cluster"), "node").groupBy("node", "cluster", "blocks", "n_cluster").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    members = written(members)
    edges = _cluster_links(members, percent, block_sets, block_shingles)
    edges = written(edges)
    components = written(connected_components(edges))
    discard(members, edges)
    named = rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = written(named.groupBy("component").agg(F.min("__key").alias("component_id"), F.count("*").alias("n")))
    named = named.withColumnRenamed("n", "n_shingles")
    linked = with_key_values(named, least, "component", max(64, table.count() // HUBS)).select(F.col("__key").alias(key), "n_shingles", "component_id")
    alone = table.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    return linked.unionByName(alone)


def _sized(of: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """Rows (node, cluster, n) with n_cluster, the sets of the cluster, and blocks, the tasks that it takes to hold them."""
    sizes = of.groupBy("cluster").agg(F.count("*").alias("n_cluster"), F.sum("n").alias("n_tokens"))
    blocks = F.greatest(F.ceil(F.col("n_cluster") / block_sets), F.ceil(F.col("n_tokens") / block_shingles)).cast("long")
    return of.join(sizes.select("cluster", "n_cluster", blocks.alias("blocks")), "cluster")


def _cluster_links(members: DataFrame, percent: int, block_sets: int, block_shingles: int) -> DataFrame:
    """Links within clusters of sets (node, cluster, blocks, n_cluster, n, tokens); large clusters are cut by further orders first."""

    def direct(of: DataFrame) -> DataFrame:
        return block_links(of.where("blocks = 1").withColumn("label", F.col("node")).withColumn("active", F.lit(True)), ["cluster"], percent)

    edges = direct(members)
    large = members.where("blocks > 1").select("node", "n", "tokens")
    if large.isEmpty():
        return edges
    large, left = written(large.withColumn("cluster", F.lit(0).cast("long"))), None
    while True:
        # counts within a cluster: its sets agree on the order, and links stay within it
        own = F.transform("tokens", lambda t: F.xxhash64(t, "cluster"))
        again = prefix_clusters(large.select("node", "n", F.col("n").alias("n_lead"), own.alias("lead")), percent)
        again = written(_sized(written(again.join(large.select("node", "n"), "node")), block_sets, block_shingles))
        cut = written(large.drop("cluster", "blocks", "n_cluster").join(again.drop("n"), "node"))
        edges = edges.union(direct(cut))
        large = cut.where("blocks > 1")
        still = large.count()
        if not still:
            return edges
        if left is not None and still > 0.9 * left:
            return edges.union(large_links(large, percent, block_sets))
        left = still


def _make_sets(size: int, percent: int, lead: int, bits: int = 64) -> Callable[[], Callable[[list], list[tuple]]]:
    """Tasks' functions from texts to (n, node, check, tokens that lead); lead: how many of 100 do."""

    def make() -> Callable[[list], list[tuple]]:
        shingles = shingler(size)

        def sets(texts: list) -> list[tuple]:
            out = []
            for text in texts:
                s = shingles(text)
                chosen = s
                if lead < 100 and len(s):
                    front = s % np.uint64(100) < lead
                    short = prefix_length(len(s), percent) - int(front.sum())
                    # what follows the leading tokens comes by value alone: it is known to be next without counts
                    chosen = s[front] if short <= 0 else np.concatenate([s[front], s[~front][:short]])
                out.append((len(s), *(set_key(s, bits) if len(s) else (None, None)), chosen.view(np.int64)))
            return out

        return sets

    return make


def one_of_each_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents' columns; of each component the row with the smallest key stays.

    Rows without shingles stay, and so do rows with a null key; rows that repeat a key are one document and stay or go
    together.
    """
    found = jaccard_components(without(docs, ["n_shingles", "component_id"]), key=key, text=text, **options)
    gone = written(found.where(F.col("component_id") != F.col(key)).select(key).distinct())
    if gone.count() <= options.get("broadcast_rows", BROADCAST_ROWS):
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
