"""Line dedup: winnowing over line hashes.

A window is a shortest run of lines with ``min_words`` words: one begins at each line, and one ends there.  Of each
window the line with the smallest hash is selected (of equal ones the last); these lines are the fingerprints.  A run
of as many words that stands in two places has the same windows in both, so they share every fingerprint.

Positions are joined by fingerprint; what no other place has drops out there.  A shared position is extended to both
sides over the windows that selected it, and a window is deleted where the very same lines stand together at one
earlier place.  Longer runs are unions of their windows, so nothing is deleted that was never repeated in one piece,
and every line of a repeated run is found.  No pairs of places are formed: the first place of a window is a minimum by
key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import broadcast_if, discard, field, longs, map_texts, without, written

MIN_WORDS = 40
#: Shared fingerprints (8 bytes each) that may be sent to all executors; beyond, the same join is shuffled.
BROADCAST_ROWS = 1_000_000
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79_A2C4E6F


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) line of the shortest runs of min_words words that begin, or end, at a line; both ends rise."""
    out = set()
    first = held = 0
    for last, n in enumerate(words):
        held += n
        if held >= min_words:
            while held - words[first] >= min_words:  # lines that are no longer needed begin a run that ended before
                held -= words[first]
                first += 1
            out.add((first, last))
    last = held = 0
    for first, n in enumerate(words):
        while last < len(words) and held < min_words:
            held += words[last]
            last += 1
        if held < min_words:
            break
        out.add((first, last - 1))
        held -= n
    return sorted(out)


def selected(hashes: list[int], runs: list[tuple[int, int]]) -> list[int]:
    """For each window the line with the smallest hash, of equal ones the last."""
    low: deque[int] = deque()  # candidates, hashes rising
    chosen, end = [], 0
    for first, last in runs:
        while end <= last:
            while low and hashes[low[-1]] >= hashes[end]:
                low.pop()
            low.append(end)
            end += 1
        while low[0] < first:
            low.popleft()
        chosen.append(low[0])
    return chosen


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def fingerprints(text: str | None, min_words: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(hash of the selected line, its position, the windows that selected it: hash, first, last)."""
    if not text:
        return []
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    runs = windows([len(x.split()) for x in lines], min_words)
    if not runs:
        return []
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    # a window's hash from those of the prefixes, whatever its length
    prefix, power = [0], [1]
    for h in hashes:
        prefix.append((prefix[-1] * _BASE + h) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    out: dict[int, list] = {}
    for (first, last), at in zip(runs, selected(hashes, runs), strict=True):
        out.setdefault(at, []).append(((prefix[last + 1] - prefix[first] * power[last + 1 - first]) % _PRIME, first, last))
    return [(_signed(hashes[at]), at, runs_of) for at, runs_of in out.items()]


def repeated_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(__id, __same, runs: array of first, last) of the texts that hold windows which stood at an earlier place.

    __same is a hash of the text, which with the key names a document.
    """

    def make() -> Callable[[list], list[tuple]]:
        return lambda texts: [(fingerprints(t, min_words),) for t in texts]

    base = docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__same"), F.col(text).alias("__text"))
    marks = field("marks", "array<struct<print:bigint,at:int,runs:array<struct<h:bigint,first:int,last:int>>>>")
    marked = written(map_texts(base, "__text", [marks], make, keep=["__id", "__same"]).where("size(marks) > 0"))
    places = marked.select("__id", "__same", F.explode("marks").alias("m")).select("__id", "__same", "m.*")
    # combined before the shuffle, so a line that a third of all texts hold is no large group
    spot = F.struct("__id", "__same", "at")
    shared = written(places.groupBy("print").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("print"))
    met = places.join(broadcast_if(shared, broadcast_rows), "print", "left_semi")
    runs = met.select("__id", "__same", "print", F.explode("runs").alias("r")).select("__id", "__same", "print", "r.*")
    spot = F.struct("__id", "__same", "first", "last")
    # both written, so that the join has two plain shuffles and a hot window's rows can be split
    runs = written(runs)
    discard(marked, shared)
    earliest = written(runs.groupBy("print", "h").agg(F.min(spot).alias("e"), F.max(spot).alias("b")).where("e <> b").drop("b"))
    later = runs.join(earliest, ["print", "h"])
    doc = F.struct("__id", "__same")
    here = F.struct(F.col("e.__id").alias("__id"), F.col("e.__same").alias("__same"))
    later = later.where((doc > here) | ((doc == here) & (F.col("first") > F.col("e.last"))))
    return later.groupBy("__id", "__same").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns, the text without its deleted lines, then n_lines, n_deleted (long) and deleted (line numbers).

    Every run of whole lines with min_words words or more that stands, line by line, at one earlier place is deleted; its
    first place stays.  Earlier is a smaller key, or a run of the same text that ends before this one begins.  A null
    text stays null and has no lines; an empty one has one.  Null keys come first.  Rows that repeat a key with the same
    text are one document, so neither deletes the other; with other texts they are documents in the order of the
    texts' hashes.  Lines are told apart by the fingerprint's 64 bits and the window's 61.  Columns with a result's
    name are replaced.
    """
    found = repeated_windows(docs, key=key, text=text, min_words=min_words, broadcast_rows=broadcast_rows)
    found = found.select("__id", "__same", F.flatten(F.transform("runs", lambda x: F.array(x["first"].cast("long"), x["last"].cast("long")))).alias("__runs"))
    base = without(docs, [n for n in ("n_lines", "n_deleted", "deleted") if n not in (key, text)])
    columns = base.columns
    joined = base.withColumn("__h", F.xxhash64(text)).join(found, base[key].eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__same")), "left")

    def make() -> Callable[[list], list[tuple]]:
        def clean(rows: list) -> list[tuple]:
            out = []
            for body, runs in rows:
                gone = {i for a, b in zip(runs[::2], runs[1::2], strict=True) for i in range(a, b + 1)} if runs else ()
                lines = [] if body is None else body.split("\n")
                out.append((body if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), sorted(gone)))
            return out

        return clean

    cleaned = map_texts(joined, text, [field(text, "string"), field("n_lines", "long"), field("n_deleted", "long"), longs("deleted")], make, keep=columns, also=["__runs"])
    return cleaned.select(*[f"`{c}`" for c in columns], "n_lines", "n_deleted", "deleted")
