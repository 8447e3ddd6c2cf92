"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources share a multiple of all words by weight, none above a multiple of its own size.  Blocks: a source's
words, laid end to end in a seeded order, are cut into blocks of equal length; Sainte-Lague's highest quotients give
each source a whole number of blocks, and each shard of a source a part of these.  Which blocks of a shard are taken
once more than the others follows from the seed.  A document gets the words of it that lie in taken blocks.

Documents are read once; blocks are never rows.  Sources' tables are small: one row a source, or a source and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import SPACE, without, written

WEIGHTS = (5, 2, 1)
#: Primes over any number of blocks in a shard; each gives an order of the blocks.
STEPS = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579)
NAMES = ["size", "source_size", "target", "taken", "full", "once_more"]


def targets(sizes: DataFrame, source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources by code point, null last.

    The level at which weight * level, but no more than most * size, adds up to share * all sizes: what sources can't
    take is shared again by weight until none is above.  Sources of no words have target 0.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    one = Window.partitionBy()
    by_fill = Window.orderBy("fill", F.col(source).isNull(), F.col(source))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("fill", F.col("cap") / F.col("w"))
    rows = rows.withColumns(
        {
            # caps and weights of those filled before; what remains is shared by the others
            "before": F.coalesce(F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most,
            "others": F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(one) * share,
        }
    )
    rows = rows.withColumn("level", (F.col("all") - F.col("before")) / F.col("others"))
    # the first, in the order of filling up, that the level doesn't fill: those before it are full
    rows = rows.withColumn("nth", F.row_number().over(by_fill))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("nth", "level"))).over(one)["level"]
    rows = rows.withColumn("level", level)
    return rows.select(source, "source_size", F.when(F.col("level").isNull() | (F.col("fill") <= F.col("level")), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"), "w")


def sainte_lague(rows: DataFrame, seats: Column, votes: str, key: list[str], within: list[str], most: Column) -> DataFrame:
    """The rows with quota: ``seats`` dealt in each group ``within`` to the highest quotients votes / (2k + 1).

    seats: a column, equal in a group.  most: a row's limit.  Only the seats that two divisors, one surely too small
    and one surely too large, leave open are ranked: about two a row, however many seats there are.
    """
    group = Window.partitionBy(*within)
    n, all_votes = F.count("*").over(group), F.sum(votes).over(group)
    rows = rows.withColumns({"__seats": seats, "__n": n, "__votes": all_votes})
    rows = rows.withColumns({"__hi": F.col("__seats") + F.col("__n") / 2 + 1, "__lo": F.greatest(F.col("__seats") - F.col("__n") / 2 - 1, F.lit(0.0))})
    bound = lambda d: F.when(F.col("__votes") > 0, F.floor(F.col(votes) * F.col(d) / F.col("__votes") + 0.5)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"__sure": F.least(bound("__lo"), most), "__last": F.least(bound("__hi"), most)})
    rows = rows.withColumn("__given", F.sum("__sure").over(group))
    ranked = rows.where("__last > __sure").select(*within, *key, "__seats", "__given", votes, F.explode(F.sequence(F.col("__sure"), F.col("__last") - 1)).alias("k"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy((F.col(votes) / (2 * F.col("k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in key], "k"))
    won = ranked.withColumn("__rank", rank).where("__rank <= __seats - __given").groupBy(*within, *key).agg(F.count("*").alias("__won"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*within, *key]]
    out = rows.alias("a").join(won.alias("b"), on, "left").select("a.*", (F.col("a.__sure") + F.coalesce("__won", F.lit(0))).alias("quota"))
    return out.drop("__seats", "__n", "__votes", "__hi", "__lo", "__sure", "__last", "__given")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, block: int = 16, shard_docs: int = 4_000, seed: int = 1) -> DataFrame:
    """The columns (or ``keep``), then size, source_size, target, taken, full and once_more.

    size: words of the text, of a null 0.  taken: words the mix takes, repeats counted; each source's sum is within a
    block of its quota of blocks, and no row's is above twice its size.  What is taken: the text ``full`` times, and the
    words from a up to b of each span in ``once_more`` (counted from 0 in the text) once more.  Rows are laid in the order of a seeded hash of
    their key and text within shards of about ``shard_docs`` rows, so reruns agree; repeated rows are laid one after the
    other.  A null source is a source, the last.  Columns with a result's name are replaced; no rows give none.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NAMES]
    place = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")).cast("long")
    base = without(docs, [n for n in NAMES if n not in (key, text, source)]).withColumns({"size": words, "__place": place})
    base = written(base.select(*dict.fromkeys([*[f"`{c}`" for c in kept], f"`{source}`", "size", "__place"])))
    sources = base.groupBy(F.col(source).alias("src")).agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / shard_docs).cast("long").alias("shards"))
    sources = written(sources)
    aims = targets(sources.select("src", "source_size"), "src", share, most, weights).join(sources.select(F.col("src").alias("__s"), "shards"), F.col("src").eqNullSafe(F.col("__s"))).drop("__s")
    # blocks of a source: the last may be short
    aims = aims.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    seats = F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5).cast("long")
    aims = written(sainte_lague(aims, seats, "target", ["src"], [], 2 * F.col("blocks")))
    named = base.join(aims, base[source].eqNullSafe(aims["src"])).withColumn("shard", F.pmod("__place", "shards"))
    shards = named.groupBy("src", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("blocks").alias("blocks"))
    in_source = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("begin", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
    # a block belongs to the shard in which its first word lies
    upto = lambda c: F.ceil(c / block).cast("long")
    shards = shards.withColumns({"block_from": upto(F.col("begin")), "block_to": upto(F.col("begin") + F.col("words"))}).withColumn("n_blocks", F.col("block_to") - F.col("block_from"))
    full = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0)).cast("long")
    shards = shards.withColumn("full", full).withColumn("rest", F.col("quota") - F.col("full") * F.col("blocks")).withColumn("votes", F.col("n_blocks").cast("double"))
    shards = sainte_lague(shards.drop("quota"), F.col("rest"), "votes", ["shard"], ["src"], F.col("n_blocks")).withColumnRenamed("quota", "extra")
    # the shards' taken blocks are told by arithmetic: block j is taken once more where (step * j + shift) mod n < extra
    step = F.element_at(F.array(*[F.lit(x) for x in STEPS]), (F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), F.lit(len(STEPS))) + 1).cast("int"))
    shards = written(shards.withColumns({"step": step, "shift": F.pmod(F.xxhash64(F.lit(seed + 1), "src", "shard"), F.lit(1 << 31))}).select("src", "shard", "begin", "full", "extra", "block_from", "n_blocks", "step", "shift"))
    # a block that begins in one shard may end in the next: its rule is looked up in the shard before
    before = Window.partitionBy("src").orderBy("shard")
    rules = F.struct("block_from", "n_blocks", "extra", "step", "shift")
    shards = _with_earlier(shards, rules, before)
    laid = named.join(shards.withColumnRenamed("src", "__src").withColumnRenamed("shard", "__shard"), named["src"].eqNullSafe(F.col("__src")) & (named["shard"] == F.col("__shard")))
    order = Window.partitionBy("src", "shard").orderBy("__place", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("first_word", F.col("begin") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    end = F.col("first_word") + F.col("size")

    def extra_of(j: Column, r: Column) -> Column:
        return F.when(r["n_blocks"] > 0, F.pmod(r["step"] * F.pmod(j - r["block_from"], r["n_blocks"]) + r["shift"], r["n_blocks"]) < r["extra"]).otherwise(False)

    def taken_once_more(j: Column) -> Column:
        return F.when(j >= F.col("here.block_from"), extra_of(j, F.col("here"))).otherwise(F.coalesce(extra_of(j, F.col("earlier")), F.lit(False)))

    spans = F.transform(
        F.filter(F.sequence(F.floor(F.col("first_word") / block).cast("long"), F.floor((end - 1) / block).cast("long")), taken_once_more),
        lambda j: F.struct((F.greatest(F.col("first_word"), j * block) - F.col("first_word")).alias("a"), (F.least(end, (j + 1) * block) - F.col("first_word")).alias("b")),
    )
    laid = laid.withColumn("once_more", F.when(F.col("size") > 0, spans).otherwise(F.expr("CAST(array() AS array<struct<a:bigint,b:bigint>>)")))
    extra = F.aggregate("once_more", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    laid = laid.withColumn("taken", F.col("size") * F.col("full") + extra)
    return laid.select(*[f"`{c}`" for c in kept], "size", "source_size", "target", "taken", "full", "once_more")


def _with_earlier(shards: DataFrame, rules: Column, before) -> DataFrame:
    """here: the shard's own blocks; earlier: those of the last shard before it in which a block begins."""
    shards = shards.withColumn("here", rules)
    earlier = F.last(F.when(F.col("n_blocks") > 0, F.col("here")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("earlier", earlier).select("src", "shard", "begin", "full", "here", "earlier")
