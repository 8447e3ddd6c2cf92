"""What a text asks for: mentions with their place, section and polarity, and requirements that they come to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyroom.operators.dictionary import JOINED, automaton_of, folded, hits

#: Of the parser's confidence: where a section or a word of the clause says what is meant, and where nothing does.
TOLD, UNTOLD = 0.65, 0.35
_END = re.compile(r"[.!?](?=\s|$)|[;\n•·]")


@dataclass(frozen=True)
class Cues:
    """Words by which a clause is read, folded, and headings by section: patterns on the whole folded line."""

    negated: tuple[str, ...] = ("not", "no", "never", "without", "nie", "bez")
    preferred: tuple[str, ...] = ("nice to have", "preferred", "optional", "plus", "mile widziane", "atutem")
    required: tuple[str, ...] = ("required", "must", "necessary", "wymagane", "konieczne")
    headings: tuple[tuple[str, str], ...] = (("REQUIRED", "requirements:?|wymagania:?"), ("PREFERRED", "nice to have:?|mile widziane:?"), ("DUTIES", "duties:?|responsibilities:?|obowiazki:?"))


def _pattern(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words)) or '(?!)'})(?!\w)")


def mentions(docs: DataFrame, key: str, text: str, phrases: list[str], cues: Cues = Cues(), joined: str = JOINED) -> DataFrame:  # noqa: B008
    """(key, phrase, start, end, line, section, polarity, confidence): every place of the phrases, and what it is there.

    section: of the last heading at or above the line, null before the first.  A clause ends at . ! ? before white space,
    at ; bullets and line ends.  polarity: NEGATED if a negation stands before the phrase in its clause; else REQUIRED or
    PREFERRED by a word of the clause, the one that stands nearest before the phrase, or else the first behind it; else by
    the section; else INFORMATION.  Places are code points of the text as it stands.  Headings hold no mention.
    joined: signs that belong to a word beside letters and digits: by default C is not mentioned in C++ or C#.
    """
    kinds = [docs.schema[key].dataType, T.StringType(), T.LongType(), T.LongType(), T.IntegerType(), T.StringType(), T.StringType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([key, "phrase", "start", "end", "line", "section", "polarity", "confidence"], kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, no = automaton_of(phrases), _pattern(cues.negated)
        soft, hard = _pattern(cues.preferred), _pattern(cues.required)
        heads = [(s, re.compile(p)) for s, p in cues.headings]

        def read(clause: str, at: int, end: int, section: str | None) -> tuple[str, float]:
            before, after = folded(clause[:at])[0], folded(clause[end:])[0]
            if no.search(before):
                return "NEGATED", TOLD
            told = [(m.start(), k) for k, p in (("PREFERRED", soft), ("REQUIRED", hard)) for m in p.finditer(before)]
            if told:
                return max(told)[1], TOLD
            told = [(m.start(), k) for k, p in (("PREFERRED", soft), ("REQUIRED", hard)) for m in [p.search(after)] if m]
            if told:
                return min(told)[1], TOLD
            return (section, TOLD) if section in ("REQUIRED", "PREFERRED") else ("INFORMATION", UNTOLD)

        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(hits(t, automaton, joined), key=lambda h: h[1:]) if t else []
                if not found:
                    continue
                ends = [0, *[m.end() for m in _END.finditer(t)], len(t) + 1]
                lines, section, at = [], None, 0
                for number, line in enumerate(t.split("\n")):
                    bare = folded(line.strip())[0]
                    head = next((s for s, p in heads if bare and p.fullmatch(bare)), None)
                    section = head or section
                    lines.append((at, number, section, head is not None))
                    at += len(line) + 1
                here, clause = 0, 0
                for phrase, a, b in found:
                    while here + 1 < len(lines) and lines[here + 1][0] <= a:
                        here += 1
                    while ends[clause + 1] <= a:
                        clause += 1
                    _, number, section, is_head = lines[here]
                    if not is_head:
                        low, high = ends[clause], max(b, ends[clause + 1])
                        out.append((k, phrase, a, b, number, section, *read(t[low:high], a - low, b - low, section)))
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(x)) for v, x in zip(columns, kinds, strict=True)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def extracted_requirements(found: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(key, name, priority, n, first, confidence): what mentions come to, by the name that a phrase stands for.

    names: (phrase, name), a phrase that lacks is its own name.  Negated mentions are none.  priority: REQUIRED before
    PREFERRED before INFORMATION; first: the first place of a mention that has it; confidence: the greatest of those.
    """
    rank = F.when(F.col("polarity") == "REQUIRED", 2).when(F.col("polarity") == "PREFERRED", 1).otherwise(0)
    rows = found.where("polarity <> 'NEGATED'").join(names.select("phrase", "name").distinct(), "phrase", "left")
    rows = rows.select(key, F.coalesce("name", "phrase").alias("name"), rank.alias("r"), "start", "confidence")
    by = rows.groupBy(key, "name", "r").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("confidence").alias("confidence"))
    best = by.groupBy(key, "name").agg(F.sum("n").alias("n"), F.max(F.struct("r", "first", "confidence")).alias("b"))
    word = F.when(F.col("b.r") == 2, "REQUIRED").when(F.col("b.r") == 1, "PREFERRED").otherwise("INFORMATION")
    return best.select(key, "name", word.alias("priority"), "n", "b.first", "b.confidence")
