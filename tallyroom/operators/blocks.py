"""Documents as blocks: columns put one after the other, blocks under their headings, and where blocks stand in another text."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyroom.functions.text import fold, let

#: Signs that no text holds, between which blocks are told while they are one string.
_CUT, _NAME = "\u0001", "\u0002"


def unwrapped_columns(text: Column, roles: list[str], firms: list[str], share: float = 0.28, least: int = 4, bar: str = "|") -> Column:
    """A text of two columns side by side with the left one before the right one, parted by an empty line; any other text as it is.

    Two columns: at least ``share`` of the lines that say something, which are ``least`` or more, have text on both sides
    of their first bar.  But where two such lines or more, and half of them, name a role on the left and a firm on the
    right, the bar parts fields, and the text stays.  roles, firms: words.  Lines without a bar are of the left column.
    """
    word = lambda t, words: F.concat(F.lit(" "), F.regexp_replace(fold(t), "[^\\p{L}\\p{N}]+", " "), F.lit(" ")).rlike("|".join(f" {w} " for w in words)) if words else F.lit(False)

    def sides(line: Column) -> Column:
        at = F.instr(line, bar)
        return F.struct((at > 0).alias("barred"), F.trim(F.when(at > 0, F.left(line, at - 1)).otherwise(line)).alias("left"), F.trim(F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise("")).alias("right"))

    def put(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.trim(F.concat(x["left"], x["right"])).rlike("\\S") | x["barred"])
        # of the part behind the first bar what a second bar leaves
        both = F.filter(lines, lambda x: x["barred"] & (x["left"] != "") & (F.trim(F.split(x["right"], "\\|")[0]) != ""))
        fields = F.filter(both, lambda x: word(x["left"], roles) & word(x["right"], firms))
        wide = (F.size(full) >= least) & (F.size(both) >= share * F.size(full)) & (F.size(both) > 0) & ~((F.size(fields) >= 2) & (F.size(fields) >= 0.5 * F.size(both)))
        column = lambda side: F.filter(F.transform(lines, lambda x: x[side]), lambda t: t != "")
        return F.when(wide, F.array_join(F.concat(column("left"), F.array(F.lit("")), column("right")), "\n")).otherwise(text)

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), sides), put)


def text_blocks(docs: DataFrame, key: str, text: str, headings: dict[str, str], first: str = "HEADER") -> DataFrame:
    """(key, block, section, content): runs of lines between headings; the heading before a block is its section.

    headings: name to a pattern on the whole lower-case line.  Lines are trimmed and empty ones left out; headings without
    lines give no block.  Blocks count from 0.  A text's lines stay in its row: nothing is shuffled.
    """
    name = F.lit(None).cast("string")

    def marked(line: Column) -> Column:
        kind = name
        for n, p in reversed(list(headings.items())):
            kind = F.when(F.lower(line).rlike(f"^(?:{p})$"), F.lit(n)).otherwise(kind)
        return let(kind, lambda k: F.when(k.isNotNull(), F.concat(F.lit(_CUT), k, F.lit(_NAME))).otherwise(line))

    flat = F.translate(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), _CUT + _NAME, "")
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.concat(F.lit(first + _NAME), F.array_join(F.transform(lines, marked), "\n"))
    parts = F.transform(F.split(whole, _CUT), lambda p: F.struct(F.split(p, _NAME)[0].alias("section"), F.regexp_replace(F.split(p, _NAME)[1], "^\n+|\n+$", "").alias("content")))
    blocks = F.filter(parts, lambda p: p["content"] != "")
    return docs.select(key, F.posexplode(blocks).alias("block", "p")).select(key, "block", "p.section", "p.content")


def _placed(blocks: DataFrame, texts: DataFrame, key: str, block: str, content: str, text: str, weight: Column, least: int = 3) -> DataFrame:
    """(key, blocks): a row a text, with struct(block, place, w) of each of its key's blocks, found as ``located_blocks`` has it."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "\\s+", " "))
    sought = blocks.select(key, F.col(block).alias("block"), plain(content).alias("c"), weight.cast("double").alias("w"))
    # a document's blocks together are no longer than the document
    packed = sought.groupBy(key).agg(F.collect_list(F.struct("block", "c", "w")).alias("blocks"))
    rows = packed.join(texts.select(key, plain(text).alias("t")), key, "left").select(key, "blocks", F.coalesce("t", F.lit("")).alias("t"))
    placed = T.StructType([T.StructField("block", blocks.schema[block].dataType), T.StructField("place", T.LongType()), T.StructField("w", T.DoubleType())])
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("blocks", T.ArrayType(placed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for batch in batches:
            at, out = [], []
            for i, (some, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                some = [b for b in some if len(b["c"]) >= least]
                if not some:
                    continue
                automaton, places = ahocorasick.Automaton(), {}
                for b in some:
                    automaton.add_word(b["c"], b["c"])
                automaton.make_automaton()
                for end, c in automaton.iter(t):
                    places.setdefault(c, end - len(c) + 1)
                at.append(i)
                out.append([(b["block"], places.get(b["c"]), b["w"]) for b in some])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, to_arrow_type(schema["blocks"].dataType))], names=schema.names)

    return rows.mapInArrow(run, schema)


def located_blocks(blocks: DataFrame, texts: DataFrame, key: str, block: str, content: str, text: str, least: int = 3) -> DataFrame:
    """(key, block, place): the first place of each block in the text of its key, in signs of the searched form; null where it isn't there.

    Both are searched lower-cased, trimmed, with runs of white space as one space; blocks of fewer than ``least`` signs
    are left out.  The blocks of a text are sought together: an automaton of them reads it once.
    """
    placed = _placed(blocks, texts, key, block, content, text, F.lit(1.0), least)
    return placed.select(key, F.explode("blocks").alias("b")).select(key, F.col("b.block").alias(block), "b.place")


@F.pandas_udf(T.LongType())
def longest_run(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The length of the longest run of an array's members that rises, with others between."""
    for batch in places:
        out = []
        for row in batch:
            tails: list[int] = []
            for p in () if row is None else row:
                at = bisect_left(tails, p)
                tails[at : at + 1] = [p]
            out.append(len(tails))
        yield pd.Series(out)


def turned_pairs(rows: list[tuple]) -> tuple[float, float]:
    """Of rows (first, second, weight): the weight of all pairs that differ in both orders, and of those that the two put the other way round.

    As ``texts.order_discordance`` counts them, for the rows of one document: a pair weighs as its lighter row; pairs are
    counted once a distinct weight, against the places before in order.
    """
    every = turned = below = 0.0
    for layer in sorted({w for _, _, w in rows}):
        before, comparable, discordant = [], 0, 0
        for _, same in groupby(sorted(r[:2] for r in rows if r[2] >= layer), key=itemgetter(0)):
            places = [place for _, place in same]
            for place in places:
                through = bisect_right(before, place)
                comparable += bisect_left(before, place) + len(before) - through
                discordant += len(before) - through
            for place in places:
                insort(before, place)
        every, turned, below = every + (layer - below) * comparable, turned + (layer - below) * discordant, layer
    return every, turned


@F.pandas_udf(T.DoubleType())
def block_discordance(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of an array of struct(block, place, w) of found blocks: the share of the weight of pairs that stand the other way round; null without a pair."""
    for batch in blocks:
        out = []
        for row in batch:
            every, turned = turned_pairs([(b["block"], b["place"], b["w"]) for b in row])
            out.append(turned / every if every > 0 else None)
        yield pd.Series(out, dtype="Float64")


def source_agreement(blocks: DataFrame, texts: DataFrame, key: str, block: str, content: str, text: str, importance: Column) -> DataFrame:
    """(key, n_blocks, n_located, coverage, in_order, discordance): how much of its blocks a text keeps, and in which order.

    coverage: the share of importance of the blocks that are found.  in_order: how many found blocks a longest rising run
    of places holds.  discordance: the weight of pairs that stand the other way round; a pair weighs as its less
    important block, 0.1 at least; null without a pair.  Blocks are made and sought once; what follows reads a document's
    places, no texts.
    """
    placed = _placed(blocks, texts, key, block, content, text, importance).where(F.col(key).isNotNull())
    # texts of one key, if there are several, are told as one
    rows = placed.groupBy(key).agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    found = F.array_sort(F.filter("blocks", lambda b: b["place"].isNotNull()))
    weighed = F.transform("found", lambda b: F.struct(b["block"].alias("block"), b["place"].alias("place"), F.greatest(b["w"], F.lit(0.1)).alias("w")))
    weight = lambda c: F.aggregate(c, F.lit(0.0), lambda n, b: n + F.coalesce(b["w"], F.lit(0.0)))
    return rows.withColumn("found", found).select(
        key, F.size("blocks").cast("long").alias("n_blocks"), F.size("found").cast("long").alias("n_located"), (weight("found") / F.nullif(weight("blocks"), F.lit(0.0))).alias("coverage"),
        longest_run(F.transform("found", lambda b: b["place"])).alias("in_order"), block_discordance(weighed).alias("discordance"),
    )
