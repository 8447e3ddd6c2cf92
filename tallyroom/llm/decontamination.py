"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words are inserted into one automaton; each document's words stream through it while the length
of the longest match that ends at the word, up to the window, is kept.  A match of ``window`` words marks words as hit;
so does an occurrence of a whole item that is shorter than the window.  Documents go through in one narrow pass, without
a shuffle.  Items of more than ``block_words`` words take a pass for each block of them; such a pass writes the marks
of the texts that are hit alone, so one automaton lives at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm.common import PLAIN_BYTES, broadcast_if, field, longs, map_texts, plain_words, without, written

WINDOW = 13
#: Words of test items in one automaton (about 2 states a word, some 100 MB); more items take more passes.
BLOCK_WORDS = 150_000
#: Parts by hash in which items' pieces are numbered; their sums are all that the driver sees of them.
PARTS = 1_024
#: Marked texts that may be sent to all executors; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000


class SuffixAutomaton:
    """All substrings of several word sequences; states know the items whose windows they hold."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, codes in coded:
            at = 0
            for code in codes:
                at = self._extend(at, code)
        self.held: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for item, codes in coded:
            at = 0
            for i, code in enumerate(codes):
                at = self.step[at][code]
                if i + 1 >= window:
                    at = self._of_length(at, window)
                    self.held.setdefault(at, set()).add(item)
            if len(codes) < window:
                self.short.setdefault(at, []).append((len(codes), item))
        self.least = min([window, *[n for marks in self.short.values() for n, _ in marks]])
        # the nearest state on the way up, itself included, where a short item ends; -1 if none
        self.marked = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.short else self.marked[self.link[s]] if s else -1

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length), self.link.append(link), self.step.append(step)
        return len(self.length) - 1

    def _split(self, above: int, code: int, below: int) -> int:
        twin = self._state(self.length[above] + 1, self.link[below], dict(self.step[below]))
        self.link[below] = twin
        while above >= 0 and self.step[above].get(code) == below:
            self.step[above][code] = twin
            above = self.link[above]
        return twin

    def _extend(self, last: int, code: int) -> int:
        """The state of the sequence read so far plus one word."""
        below = self.step[last].get(code)
        if below is not None:
            return below if self.length[below] == self.length[last] + 1 else self._split(last, code, below)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and code not in self.step[last]:
            self.step[last][code] = new
            last = self.link[last]
        if last >= 0:
            below = self.step[last][code]
            self.link[new] = below if self.length[below] == self.length[last] + 1 else self._split(last, code, below)
        return new

    def _of_length(self, state: int, n: int) -> int:
        """The state that holds the last n words of a match of n or n + 1 words: this one or the one above."""
        return self.link[state] if self.length[self.link[state]] >= n else state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Word intervals [first, end) of the occurrences, merged, in order; and the items that occur."""
        spans: list[list[int]] = []
        found: set = set()
        step, link, length, window, least = self.step, self.link, self.length, self.window, self.least
        at = long = 0
        for i, code in enumerate(map(self.vocabulary.get, words)):
            if code is None:
                at = long = 0
                continue
            to = step[at].get(code)
            while to is None and at:
                at = link[at]
                long = length[at]
                to = step[at].get(code)
            if to is None:
                continue
            at = to
            long += 1
            if long < least:
                continue
            reach = 0
            if long >= window:
                # no more words than the window are kept, so each step goes up one link at most
                at, long = self._of_length(at, window), window
                found |= self.held[at]
                reach = window
            mark = self.marked[at]
            while mark > 0:
                for n, item in self.short[mark]:
                    if n <= long:
                        found.add(item)
                        reach = max(reach, n)
                mark = self.marked[link[mark]]
            if reach:
                first = i + 1 - reach
                while spans and spans[-1][1] >= first:  # a short item may end within a span that began later
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        return spans, found


def pieces(item: object, words: list[bytes], most: int, window: int) -> list[tuple[object, list[bytes]]]:
    """An item in pieces of at most ``most`` words that overlap by window - 1: the same windows."""
    if len(words) <= most:
        return [(item, words)] if words else []
    return [(item, words[i : i + most]) for i in range(0, len(words) - window + 1, most - window + 1)]


def item_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[list[tuple[tuple[str, ...], list[bytes]]]]:
    """The items' pieces, each with the ids that have it, in blocks of at most twice ``block_words`` words and ids; one block on the driver at a time.

    A piece weighs its words and its ids, and is ``block_words`` words at most (or two windows); where more items share it,
    their ids are parted.  Equal pieces are told once.  Pieces are numbered by running total: within parts by hash, which
    the parts' sums continue.  Each block is a filter on a written table.
    """

    def make() -> Callable[[list], list[tuple]]:
        def cut_up(rows: list) -> list[tuple]:
            parts = [[(len(p), " ".join(w.decode("utf-8", "surrogatepass") for w in p)) for _, p in pieces(None, plain_words(body), max(block_words, 2 * window), window)] for body in rows]
            return [(p,) for p in parts]

        return cut_up

    named = items.select(F.col(item_id).cast("string").alias("__item"), F.col(text).alias("__body")).where("__item IS NOT NULL AND __body IS NOT NULL")
    cut_items = map_texts(named, "__body", [field("__pieces", "array<struct<n:bigint,words:string>>")], make, keep=["__item"])
    table = written(cut_items.select("__item", F.explode("__pieces").alias("p")).select("__item", "p.n", "p.words").distinct())
    shared = table.groupBy("words").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
    if shared is None:
        return
    parts = -(-2 * shared // block_words)
    one = table.groupBy("words", "n", F.pmod(F.xxhash64("__item"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list("__item")).alias("items"))
    part = F.pmod(F.xxhash64("words", "part"), F.lit(PARTS))
    weighed = written(one.withColumns({"weight": F.col("n") + F.size("items"), "bucket": part}))
    sums = {r["bucket"]: r["s"] for r in weighed.groupBy("bucket").agg(F.sum("weight").alias("s")).collect()}  # PARTS rows at most
    before = dict(zip(sorted(sums), accumulate([0, *[sums[k] for k in sorted(sums)]]), strict=False))
    offsets = F.broadcast(items.sparkSession.createDataFrame(list(before.items()), "bucket long, before long"))
    here = Window.partitionBy("bucket").orderBy("words", "part")
    upto = F.sum("weight").over(here) - F.col("weight") + F.col("before")
    dealt = weighed.join(offsets, "bucket").withColumn("block", F.floor(upto / F.lit(block_words)).cast("int"))
    if sum(sums.values()) > block_words:
        dealt = written(dealt)
    for block in range(-(-sum(sums.values()) // block_words)):
        rows = dealt.where(F.col("block") == block).select("items", "words").collect()
        if rows:
            yield [(tuple(r["items"]), r["words"].encode("utf-8", "surrogatepass").split(b" ")) for r in rows]


def _scanner(block: list[tuple[tuple[str, ...], list[bytes]]], window: int) -> Callable[[], Callable]:
    def make() -> Callable[[list], list[tuple]]:
        automaton = SuffixAutomaton([(k, words) for k, (_, words) in enumerate(block)], window)

        def scan(texts: list) -> list[tuple]:
            out = []
            for text in texts:
                words = plain_words(text)
                spans, found = automaton.scan(words)
                out.append((len(words), [x for s in spans for x in s], sorted({i for k in found for i in block[k][0]})))
            return out

        return scan

    return make


def _merged(flat: list[int]) -> list[int]:
    out: list[int] = []
    for first, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


_MARKS = [field("n_words", "long"), longs("hit_spans"), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def _over_blocks(base: DataFrame, text: str, kept: list[str], blocks: list, window: int, broadcast_rows: int) -> DataFrame:
    """Marks of several blocks: of each block those of the texts that it hits, joined back by the text's hashes."""
    name = ["__h1", "__h2"]
    hashes = {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}
    bodies = base.select(F.col(text).alias("__body")).where("__body IS NOT NULL").withColumns({"__h1": F.xxhash64("__body"), "__h2": F.xxhash64(F.lit(1), "__body")})
    hits = None
    for n, block in enumerate(blocks):
        new = written(map_texts(bodies, "__body", _MARKS, _scanner(block, window), keep=name).where("size(hit_spans) > 0").drop("n_words")).withColumn("block", F.lit(n))
        hits = new if hits is None else hits.union(new)
    # equal texts have equal marks: one row a text and block, combined before the shuffle
    one = hits.groupBy(*name, "block").agg(F.first("hit_spans").alias("hit_spans"), F.first("item_ids").alias("item_ids"))
    hits = written(one.groupBy(*name).agg(F.flatten(F.collect_list("hit_spans")).alias("__spans"), F.flatten(F.collect_list("item_ids")).alias("__items")))

    def make() -> Callable[[list], list[tuple]]:
        return lambda rows: [(len(plain_words(body)), _merged(spans or []), sorted(set(found or []))) for body, spans, found in rows]

    joined = base.withColumns(hashes).join(broadcast_if(hits, broadcast_rows), name, "left")
    return map_texts(joined, text, _MARKS, make, keep=kept, also=["__spans", "__items"])


def find_contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = 0.05, block_words: int = BLOCK_WORDS, broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | None = None
) -> DataFrame:
    """The documents' columns (or ``keep``), then what of each occurs in the items.

    n_words, n_hit, n_items: long; hit_spans: array of first, end, first, end ... in words; item_ids: strings, sorted;
    contaminated: n_hit > 0 and n_hit >= coverage * n_words.  A null or empty text has no words and is never
    contaminated.  Items with a null id or a null or empty text match nothing; items with equal texts or ids each count
    once by id.  Repeated document rows give repeated rows.  A column that has one of these names is replaced.  No
    items: no hits.
    """
    base = without(docs, [n for n in ("n_words", "n_hit", "n_items", "hit_spans", "item_ids", "contaminated") if n != text])
    kept = [c for c in (base.columns if keep is None else keep)]
    base = base.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    blocks = item_blocks(items, item_id, item_text, window, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = map_texts(base, text, _MARKS, lambda: _scanner(first, window)(), keep=kept)
    else:
        out = _over_blocks(base, text, kept, chain([first, second], blocks), window, broadcast_rows)
    n_hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long")})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(coverage) * F.col("n_words")))
    return out.select(*[f"`{c}`" for c in kept], "n_words", "n_hit", "n_items", "hit_spans", "item_ids", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", max_coverage: float = 0.05, max_span: int = WINDOW, **options) -> DataFrame:
    """The documents' columns: rows over the coverage limit go; in the others, spans of max_span words or more are cut.

    A span is cut from its first word up to the next word that is kept.  All other rows come through unchanged, null
    and empty texts too.
    """
    columns = docs.columns
    marked = find_contamination(docs, items, text=text, coverage=max_coverage, **options).where("NOT contaminated")

    def make() -> Callable[[list], list[tuple]]:
        return lambda rows: [(cut(body, spans, max_span) if spans else body,) for body, spans in rows]

    return map_texts(marked, text, [field(text, "string")], make, keep=columns, also=["hit_spans"]).select(*[f"`{c}`" for c in columns])


def cut(text: str, spans: list[int], max_span: int) -> str:
    body = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in PLAIN_BYTES.finditer(body.lower())] + [(len(body), len(body))]
    out, at = [], 0
    for first, end in zip(spans[::2], spans[1::2], strict=True):
        if end - first >= max_span:
            out.append(body[at : places[first][0]])
            at = places[end][0]
    return b"".join([*out, body[at:]]).decode("utf-8", "surrogatepass")
