"""Text column functions; all of them stay in the JVM but for ``jaro_winkler`` and ``fingerprint``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _marked() -> dict[str, str]:
    """Lower-case letters that are a base letter and marks, and the base letter; the stroked l has no such form."""
    out = {"ł": "l"}
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and all(0x300 <= ord(m) <= 0x36F for m in marks):
            out[c] = base
    return out


LETTERS = _marked()
MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(text: Column, letters: dict[str, str] = LETTERS) -> Column:
    """Lower case without marks, of all scripts; marks that stand alone go too."""
    return F.translate(F.lower(text), "".join(letters) + MARKS, "".join(letters.values()))


def normal_term(text: Column) -> Column:
    """Folded; only a-z, 0-9, spaces and hyphens stay, runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9 -]", " "), " +", " "))


#: What messages are scrubbed of, in this order, since the groups that they form must be the same.
SCRUBBED = (
    ("https?://\\S+", "[url]"),
    ("(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b", "[uuid]"),
    ("eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*", "[jwt]"),
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[email]"),
)


def scrub(text: Column, most: int = 300) -> Column:
    """Without urls, uuids, tokens, addresses and digits, in this order: a url holds what later patterns look for."""
    out = text
    for pattern, name in SCRUBBED:
        out = F.regexp_replace(out, pattern, name)
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[0-9]+", "#"), "[ \\t\\n\\r\\f]+", " "))
    return F.substring(out, 1, most)


def redact(text: Column) -> Column:
    """Addresses and phone numbers of nine digits or more are hidden."""
    out = F.regexp_replace(text, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(out, "\\+?[0-9](?:[ -]?[0-9]){8,14}", "[phone]")


#: Letters of one sound, folded one after the other.
SOUNDS = (("rz", "z"), ("sz", "s"), ("cz", "c"), ("ch", "h"))


def phonetic(text: Column, sounds: tuple = SOUNDS) -> Column:
    """Folded, sounds made one, then a-z and 0-9 alone."""
    out = fold(text)
    for long, short in sounds:
        out = F.replace(out, F.lit(long), F.lit(short))
    return F.regexp_replace(out, "[^a-z0-9]", "")


def salary_range(text: Column) -> Column:
    """struct(low, high): the smallest and, where there are two, the largest number above 0; no number: nulls.

    Spaces, also unbreakable and narrow ones, part thousands; a comma or a full stop is the decimal sign.
    """
    flat = F.translate(text, "\u00a0\u202f", "  ")
    found = F.regexp_extract_all(flat, F.lit("([0-9][0-9 ]*(?:[.,][0-9]+)?)"), 1)
    found = F.transform(found, lambda x: F.translate(x, ", ", ".").try_cast("double"))
    return let(F.filter(found, lambda x: x > 0), lambda n: F.struct(F.array_min(n).alias("low"), F.when(F.size(n) > 1, F.array_max(n)).alias("high")))


def url_domain(url: Column) -> Column:
    """Lower-case host without www., null where there is none."""
    host = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.regexp_replace(host, "^www\\.", ""))


def plain_tokens(text: Column, least: int = 1) -> Column:
    """Folded runs of letters and digits of any script, of ``least`` characters or more, repeats included; null has none."""
    return F.filter(F.split(F.coalesce(fold(text), F.lit("")), "[^\\p{L}\\p{N}]+"), lambda t: F.length(t) >= least)


def signed_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and the signs + # . / @ _ -, repeats included; null has none."""
    return F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), "[^\\p{L}\\p{N}+#./@_-]+"), lambda t: t != "")


#: Names whose signs would be lost, and what they are called.
NAMED = (("c\\+\\+", "cpp"), ("c#", "csharp"), ("\\.net", "dotnet"), ("node\\.js", "nodejs"), ("react\\.js", "react"), ("vue\\.js", "vue"), ("k8s", "kubernetes"))


def feature_tokens(text: Column) -> Column:
    """What a corpus is learned by: lower-case words of 2 to 48 characters with a letter, + . # / and - within; null has none.

    Brackets go with what they hold; addresses, phone numbers, urls and numbers are left out.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    named = low
    for pattern, name in NAMED:
        named = F.regexp_replace(named, f"(?:^|[^\\p{{L}}\\p{{N}}]){pattern}(?=$|[^\\p{{L}}\\p{{N}}])", f" {name} ")
    # few texts have such names: the others are spared the patterns
    out = F.when(F.contains(low, F.lit("c++")) | F.contains(low, F.lit("c#")) | F.contains(low, F.lit(".net")) | F.contains(low, F.lit(".js")) | F.contains(low, F.lit("k8s")), named).otherwise(low)
    out = F.regexp_replace(F.translate(out, "–—", "--"), "\\[[^\\]]+\\]", " ")
    words = F.transform(F.split(out, "[^\\p{L}\\p{N}+.#/-]+"), lambda t: F.regexp_replace(t, "^[+./-]+|[+./-]+$", ""))
    return F.filter(words, lambda t: F.length(t).between(2, 48) & t.rlike("\\p{L}") & ~t.rlike("^www\\."))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often, and in whatever loop, ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def token_runs(tokens: Column, n: int) -> Column:
    """struct(phrase, n, start) of each run of n tokens, joined by spaces; start counts from 1."""

    def of(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: i + n - 1 <= F.size(w))
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("phrase"), F.lit(n).alias("n"), i.alias("start")))

    return let(tokens, of)


def token_ngrams(tokens: Column, most: int = 3) -> Column:
    """The distinct runs of 1 to ``most`` tokens."""
    return let(tokens, lambda w: F.array_distinct(F.transform(F.concat(*[token_runs(w, n) for n in range(1, most + 1)]), lambda r: r["phrase"])))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the text with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams to all; texts of fewer than three letters go by Jaro and Winkler."""
    both, all_ = F.size(F.array_intersect(trigrams(a), trigrams(b))), F.size(F.array_union(trigrams(a), trigrams(b)))
    return F.when(a == b, 1.0).when((F.length(a) < 3) | (F.length(b) < 3), jaro_winkler(a, b)).otherwise(both / all_)


#: Endings of inflected words, in the order in which they are looked for.
ENDINGS = ("owego", "owych", "owym", "owski", "owska", "owek", "ami", "ach", "ego", "ych", "ich", "nym", "nej", "ow", "om", "em", "ie", "iu", "ki", "ka", "ke", "y", "a", "e", "o")


def stem_word(word: Column, endings: tuple = ENDINGS) -> Column:
    """Folded, without its first listed ending that leaves three characters; words of up to three stay as they are.

    Of a folded word a-z, 0-9 and hyphens stay.
    """
    # fixed values: one trade's word has three spellings of its stem
    bare = F.regexp_replace(F.regexp_replace(fold(word), "[^a-z0-9-]", ""), "ciol$", "cotol")
    bare = F.regexp_replace(bare, "^(.*?)kotl", "$1cotol")

    def cut(w: Column) -> Column:
        out = w
        for e in reversed(endings):
            out = F.when(F.endswith(w, F.lit(e)) & (F.length(w) >= len(e) + 3), F.substring(w, F.lit(1), F.length(w) - len(e))).otherwise(out)
        return out

    return F.when(F.length(word) <= 3, word).otherwise(let(bare, cut))


def stem_phrase(text: Column) -> Column:
    """The stems of the words between single spaces."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: stem_word(w)), " ")


#: Endings that are taken off one group after the other, where a word has one.
LIGHT_ENDINGS = (
    "nościami|nościach|nością|ności|stwem|stwach|stwu", "eniach|eniom|eniem|enie|enia|eniu", "aniach|aniom|aniem|anie|ania|aniu", "owałem|owałeś|owaliśmy|owali|ować|uję|ujesz|ują",
    "ałem|ałeś|aliśmy|ałam|ałaś", "owali|owały|owało", "ami|ach|owi|ego|emu|ich|ych|iej|iem|ym", "em|ie|om|ów|ej|ey", "a|e|i|o|u|y|ę|ą",
)


def stem_light(word: Column, groups: tuple = LIGHT_ENDINGS) -> Column:
    """Lower case without the endings of each group in turn; up to three characters, and terms of up to six of a-z 0-9 # + . -, stay."""

    def cut(w: Column) -> Column:
        out = w
        for g in groups:
            out = F.regexp_replace(out, f"(?:{g})$", "")
        return F.when((F.length(w) <= 3) | ((F.length(w) <= 6) & w.rlike("^[a-z0-9#+.-]+$")), w).otherwise(out)

    return let(F.trim(F.lower(word)), cut)


def hybrid_similarity(query: Column, target: Column) -> Column:
    """1 equal, 0.95 equal stems, 0.88 and 0.78 one in the other, 0.85 stems so; else a mean of four measures, two decimals.

    All of folded, trimmed texts: 0.35 Jaro and Winkler, 0.35 that of the stems, 0.2 trigrams, 0.1 edits.
    """
    q, t = F.trim(fold(query)), F.trim(fold(target))
    pair = F.struct(q.alias("q"), t.alias("t"), stem_phrase(q).alias("sq"), stem_phrase(t).alias("st"), jaro_winkler(q, t).alias("jw"), jaro_winkler(stem_phrase(q), stem_phrase(t)).alias("sj"), trigram_similarity(q, t).alias("tri"))

    def of(x: Column) -> Column:
        mix = 0.35 * x["jw"] + 0.35 * x["sj"] + 0.2 * x["tri"] + 0.1 * edit_similarity(x["q"], x["t"])
        out = F.when(x["q"] == x["t"], 1.0).when(x["t"].contains(x["q"]), 0.88).when(x["q"].contains(x["t"]), 0.78)
        out = out.when(x["sq"] == x["st"], 0.95).when(x["st"].contains(x["sq"]) | x["sq"].contains(x["st"]), 0.85)
        return out.otherwise(F.floor(mix * 100 + 0.5) / 100)

    return let(pair, of)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays, four decimals; two empty ones are alike in nothing."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / all_, 4))


def coverage(required: Column, present: Column) -> Column:
    """The share of the distinct required members that are present; nothing required: 1."""
    n = F.size(F.array_distinct(required))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(required, present)) / n)


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == x), None)
        if j is not None:
            taken[j] = True
            left.append(x)
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (len(left) / len(a) + len(left) / len(b) + (len(left) - moved) / len(left)) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """No built-in has it; pairs are compared in Arrow batches."""
    return pd.Series([_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h, raw = 0x811C9DC5, text.encode("utf-16-le", "surrogatepass")
    for unit in memoryview(raw).cast("H") if raw else ():
        h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
    return h


@F.pandas_udf(T.LongType())
def fnv(texts: pd.Series) -> pd.Series:
    """32-bit FNV-1a; null of null."""
    return pd.Series([None if t is None else fnv1a(t) for t in texts], dtype="Int64")


@F.pandas_udf(T.StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """8 hex digits of a text in normal form: compatibility letters composed, lower case, digit runs as one sign."""
    import re

    shape = lambda t: re.sub(r"\s+", " ", re.sub(r"\d+", "#", unicodedata.normalize("NFKC", t).lower())).strip()
    return texts.map(lambda t: None if t is None else f"{fnv1a(shape(t)):08x}")
