"""Phrases in texts: evidence with its context, optional parts, dictionaries, placeholders, stack frames, wrapped lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroom.functions.dates import parse_month
from tallyroom.functions.text import fold, let

#: Cues before or after a phrase that take its evidence away, over folded texts; small lists of our own.
NEGATION = ("not", "no", "never", "without", "nie", "bez", "brak")
LEARNING = ("learning", "plan to learn", "in training", "want to learn", "ucze sie", "w trakcie nauki")
LEAKAGE = ("job requires", "we require", "we are looking for", "requirements?:", "oferta wymaga")
OTHERS = ("(?:my|our|the) (?:colleague|team|vendor)", "zespol", "kolega")
OWN = ("i", "we", "ja")
_LETTER = "[\\p{L}\\p{N}_]"


def _any(cues: tuple[str, ...]) -> str:
    return "|".join(cues)


def bounded(phrase: str) -> str:
    """A pattern for a phrase between characters that are no letters; digits may follow as a version."""
    words = "\\s+".join(re.escape(w) for w in phrase.split())
    return f"(?<![\\p{{L}}\\p{{N}}_#+]){words}(?=(?:[0-9]+(?:\\.[0-9]+)*)?(?:[^\\p{{L}}\\p{{N}}_#+]|$))"


def phrase_count(text: Column, phrase: str) -> Column:
    """Times that a phrase stands in a text, whatever is said of it."""
    return F.regexp_count(fold(F.coalesce(text, F.lit(""))), F.lit(bounded(phrase)))


def mention(text: Column, aliases: list[str]) -> Column:
    """The first of the aliases that stands in the text, else null."""
    low = fold(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(bounded(a)), F.lit(a)) for a in aliases])


def begins_with(after: Column, cues: tuple[str, ...]) -> Column:
    """Whether what follows a phrase is one of the cues as whole words: behind a version, spaces and at most one dash or colon."""
    rest = F.ltrim(F.regexp_replace(after, "^[0-9][0-9.]*", ""), F.lit(" \t"))
    rest = F.when(F.left(rest, F.lit(1)).isin(*"—–:-"), F.ltrim(F.substring(rest, 2, 1 << 30), F.lit(" \t"))).otherwise(rest)
    return let(rest, lambda r: F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.startswith(r, c) & ~F.substring(r, F.length(c) + 1, F.lit(1)).rlike(_LETTER)))


def positive_evidence(text: Column, phrase: str, *, negation: tuple = NEGATION, learning: tuple = LEARNING, leakage: tuple = LEAKAGE, others: tuple = OTHERS, own: tuple = OWN) -> Column:
    """Whether a text holds a phrase that its clause does not take back.

    A clause ends at . ; ! ? and line ends.  An occurrence doesn't count after a negation or a word of learning in the
    70 characters before it, a requirement in the 140 before, or another's doing that no own doing follows; nor if a
    negation or learning follows at once.  Any other occurrence is enough.
    """
    clauses = F.split(fold(F.coalesce(text, F.lit(""))), "[;!?\n•·]|\\.(?=\\s|$)")
    word = lambda cues: f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:{_any(cues)})(?=[^\\p{{L}}\\p{{N}}_]|$)"

    def clean(parts: Column, i: Column) -> Column:
        before = F.array_join(F.slice(parts, F.lit(1), i + 1), phrase)
        after = F.array_join(F.slice(parts, i + 2, F.size(parts)), phrase)
        near, far = F.right(before, F.lit(70)), F.right(before, F.lit(140))
        taken = near.rlike(word((*negation, *learning))) | far.rlike(f"(?:{_any(leakage)})") | before.rlike(f"{word(others)}(?!.*{word(own)})")
        return ~(taken | begins_with(after, (*learning, *negation)))

    def of(clause: Column) -> Column:
        return let(F.split(clause, bounded(phrase)), lambda parts: F.exists(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i < F.size(parts) - 1), lambda i: clean(parts, i)))

    return F.exists(clauses, of)


def without_optional(text: Column, optional: str, required: str, sections: str) -> Column:
    """Without what an optional marker begins, up to the next section, required marker or end of the sentence."""
    return F.regexp_replace(text, f"(?is)\\b(?:{optional})\\b\\s*:?\\s*.*?(?=\\b(?:{sections})\\b\\s*:|{required}|[.!?;](?=\\s|$)|$)", " ")


def sentence_words(text: Column, stop: list[str]) -> Column:
    """Words of two characters or more without sentence signs and function words; c++ and node.js stay whole."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[,;:!?()\\[\\]{}\"'«»„”…‘’‚‛′“‟″]", " "), "\\.(?=\\s|$)", " ")
    words = F.transform(F.split(low, "\\s+"), lambda t: F.regexp_replace(t, "^[-/]+|[-/]+$", ""))
    return F.filter(words, lambda t: (F.length(t) > 1) & t.rlike("[a-ząćęłńóśźż0-9]") & ~t.isin(*stop))


#: Units that a metric may have, and the form that stands for them.
UNITS = {"%": "%", "procent": "%", "mln": "mln", "tys": "tys", "k": "k", "godzin": "godzin", "dni": "dni", "osob": "osob"}
SPACES = " \u00a0\u202f"


def said_metrics(text: Column, units: dict[str, str] = UNITS) -> Column:
    """Numbers with their unit, in one form: 40 % and 40 procent are one, groups of thousands are one number.

    A number begins where no letter, digit or underscore stands before it, and is made of an optional sign (with spaces
    behind), digits, groups of three digits behind a space, and a decimal part.  One space may part it from its unit.
    """
    digits = f"[0-9]+(?:[{SPACES}][0-9]{{3}}(?![0-9]))*"
    number = f"(?<!{_LETTER})([+−-]?)(\\s*)({digits})(?:[.,]([0-9]+))?"
    ends = "|".join(f"{re.escape(u)}(?!{_LETTER})" if len(u) == 1 and u.isalpha() else re.escape(u) for u in units)
    low = fold(F.coalesce(text, F.lit("")))
    part = lambda k: F.regexp_extract_all(low, F.lit(f"{number}(?:\\s?({ends}))?"), k)

    def one(x: Column) -> Column:
        sign = F.when(x["sign"].isin("-", "−"), "-").otherwise("")
        decimals = F.when(x["decimals"] != "", F.concat(F.lit("."), x["decimals"])).otherwise("")
        unit = F.coalesce(*[F.when(x["unit"] == u, F.lit(form)) for u, form in units.items()], F.lit(""))
        return F.concat(sign, F.translate(x["digits"], SPACES, ""), decimals, unit)

    found = F.arrays_zip(part(1).alias("sign"), part(3).alias("digits"), part(4).alias("decimals"), part(5).alias("unit"))
    return F.array_distinct(F.transform(found, one))


def substituted(text: Column, table: dict[str, str]) -> Column:
    """The lower-cased words between white space, each replaced by what the table has for it."""
    return F.array_join(F.transform(F.split(F.trim(F.lower(text)), "\\s+"), lambda w: F.coalesce(*[F.when(w == k, F.lit(v)) for k, v in table.items()], w)), " ")


def suggested_tags(text: Column, rules: list[tuple[str, str]], existing: Column) -> Column:
    """Tags whose pattern the text matches, less those that it has in any case of letters."""
    have = F.transform(F.coalesce(existing, F.array().cast("array<string>")), F.lower)
    found = F.array(*[F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(p), F.lit(t)) for t, p in rules])
    return F.filter(found, lambda t: t.isNotNull() & ~F.array_contains(have, F.lower(t)))


#: Labels and patterns of what is hidden, in this order, since the longer and narrower ones come first.
HIDDEN = (
    ("EMAIL", "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+"),
    ("ID", "\\b[0-9]{11}\\b"),
    ("LINK", "\\bhttps?://[^\\s<>\"']+"),
    ("TELEFON", "(?:\\+[0-9]{1,3}[\\s-]?)?(?:\\([0-9]{1,4}\\)[\\s-]?)?[0-9]{2,3}[\\s-]?[0-9]{2,3}[\\s-]?[0-9]{2,4}\\b"),
)


def pseudonyms(text: Column, names: Column, label: str = "KANDYDAT") -> Column:
    """struct(text, map): names, the longest first, then addresses, numbers, links and phones as numbered placeholders.

    map: array of (placeholder, value), with which ``restored`` gives the text back.  Names of fewer than three
    characters stay; so do runs of digits that are no phone number of 9 to 15.  A value has one placeholder.  Numbers
    begin behind the highest one of that label that the text itself holds, so its own placeholders stay apart.
    """
    low = F.coalesce(text, F.lit(""))
    own = lambda name: F.transform(F.regexp_extract_all(low, F.lit(f"\\[{name}(?:_([0-9]{{1,9}}))?\\]"), 1), lambda n: F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(1)))
    past = lambda name: F.coalesce(F.array_max(own(name)), F.lit(0))
    kind = "array<struct<placeholder:string,value:string>>"
    tag = lambda name, n: F.concat(F.lit(f"[{name}"), F.when(n > 0, F.concat(F.lit("_"), (n + 1).cast("string"))).otherwise(""), F.lit("]"))
    listed = F.filter(F.array_distinct(F.transform(names, lambda x: F.trim(x))), lambda v: F.length(v) >= 3)
    listed = F.transform(F.array_sort(F.transform(listed, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.array().cast(kind).alias("map"))

    def name(acc: Column, v: Column) -> Column:
        p = tag(label, F.size(acc["map"]) + past(label))
        hit = F.contains(acc["text"], v)
        return F.struct(F.when(hit, F.replace(acc["text"], v, p)).otherwise(acc["text"]).alias("text"), F.when(hit, F.concat(acc["map"], F.array(F.struct(p.alias("placeholder"), v.alias("value"))))).otherwise(acc["map"]).cast(kind).alias("map"))

    def hide(title: str, pattern: str):
        fits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15) if title == "TELEFON" else F.lit(True)

        def of(x: Column) -> Column:
            parts = F.split(x["text"], pattern)

            def placed(f: Column) -> Column:
                kinds = F.array_distinct(F.filter(f, fits))
                to = lambda v: F.when(fits(v), tag(title, (F.array_position(kinds, v) - 1).cast("int") + past(title))).otherwise(v)
                body = F.array_join(F.transform(parts, lambda s, i: F.concat(s, F.when(F.get(f, i).isNotNull(), to(F.get(f, i))).otherwise(""))), "")
                new = F.transform(kinds, lambda v, i: F.struct(tag(title, i + past(title)).alias("placeholder"), v.alias("value")))
                return F.struct(body.alias("text"), F.concat(x["map"], new).cast(kind).alias("map"))

            return let(F.regexp_extract_all(x["text"], F.lit(f"({pattern})"), 1), placed)

        return of

    out = F.aggregate(listed, start, name)
    for title, pattern in HIDDEN:
        out = let(out, hide(title, pattern))
    return out


def restored(text: Column, pairs: Column) -> Column:
    """The text with the values of the placeholders, the last made first: a value may hold a placeholder made before."""
    return F.aggregate(F.reverse(pairs), text, lambda t, p: F.replace(t, p["placeholder"], p["value"]))


#: Signs of a function's and of a file's name that are kept.
FN_SIGNS, FILE_SIGNS = 80, 120


def place_of(location: Column) -> Column:
    """struct(file, line) of file:line:column, null where it doesn't end in two numbers; of a path the last part."""
    parts = F.split(location, ":")
    n = F.size(parts)
    number = lambda k: F.get(parts, n - k).rlike("^[0-9]+$")
    whole = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ":")
    steps = F.split(whole, "[/\\\\]")
    file = F.when(F.size(steps) > 1, F.get(steps, F.size(steps) - 1)).otherwise(F.left(whole, F.lit(FILE_SIGNS)))
    return F.when((n > 2) & number(1) & number(2), F.struct(file.alias("file"), F.try_to_number(F.get(parts, n - 2), F.lit("9999999999")).cast("int").alias("line")))


def stack_frames(stack: Column, most: int = 5) -> Column:
    """The first frames (fn, file, line) of a stack, by the two forms in which engines write them, or names alone.

    One form says ``at``, then a place, or a name and a place in brackets; the other a name, ``@`` and a place, which may
    lack.  A line that says neither is a frame's name, unless it is a message (a word and a colon) or holds a bracket.
    """
    none = F.lit(None).cast("string")

    def frame(fn: Column, place: Column) -> Column:
        return F.struct(F.left(F.nullif(fn, F.lit("")), F.lit(FN_SIGNS)).alias("fn"), place["file"].alias("file"), place["line"].alias("line"))

    def after_at(body: Column) -> Column:
        """The rest of a line behind ``at``."""
        open_at = F.instr(body, " (")
        inner = F.substring(body, open_at + 2, F.length(body) - open_at - 2)
        bracketed = F.when((open_at > 1) & F.endswith(body, F.lit(")")), place_of(inner))
        named = lambda p: frame(F.rtrim(F.left(body, open_at - 1)), p)
        return F.when(bracketed.isNotNull(), named(bracketed)).when(place_of(body).isNotNull(), frame(none, place_of(body))).otherwise(frame(body, place_of(none)))

    def behind_sign(line: Column) -> Column:
        at = F.instr(line, "@")
        return frame(F.left(line, at - 1), place_of(F.substring(line, at + 1, F.length(line))))

    def read(line: Column) -> Column:
        at, rest = F.instr(line, "@"), F.substring(line, F.instr(line, "@") + 1, F.length(line))
        signed = (at > 0) & ((rest == "") | place_of(rest).isNotNull())
        message = line.rlike("^[A-Za-z_$][A-Za-z0-9_$]*(?:\\[[A-Za-z0-9_]+\\])?:\\s")
        body = F.trim(F.substring(line, 3, 1 << 30))
        says_at = F.left(line, F.lit(3)).isin("at ", "at\t")
        placed = place_of(body).isNotNull() | (F.endswith(body, F.lit(")")) & (F.instr(body, " (") > 1))
        return F.when(says_at & placed, after_at(body)).when(signed, behind_sign(line)).when(message, frame(none, place_of(none))).when(says_at, frame(body, place_of(none))).when(~line.rlike("[@()]"), frame(line, place_of(none)))

    lines = F.filter(F.transform(F.split(F.coalesce(stack, F.lit("")), "\n"), lambda x: F.trim(x)), lambda t: (t != "") & (t != "Error"))
    return F.slice(F.filter(F.transform(lines, read), lambda f: f["fn"].isNotNull() | f["file"].isNotNull()), 1, most)


def wrapped(text: Column, width: float, most: int, wide: str = "mwMW", narrow: str = "ijlt") -> Column:
    """struct(text, n_lines): words laid in lines of a width, at most so many; what doesn't fit is left out.

    A character is 1 wide, one of ``wide`` 1.5 and one of ``narrow`` 0.5; a word that is wider than a line has its own.
    """
    measure = lambda t: F.length(t) + 0.5 * (F.length(t) - F.length(F.translate(t, wide, ""))) - 0.5 * (F.length(t) - F.length(F.translate(t, narrow, "")))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("n"), F.lit("").alias("line"))

    def lay(acc: Column, w: Column) -> Column:
        longer = F.trim(F.concat_ws(" ", acc["line"], w))
        fits = measure(longer) <= width
        ends = ~fits & (acc["line"] != "")
        return F.when(acc["n"] >= most, acc).otherwise(
            F.struct(F.when(ends, F.trim(F.concat_ws(" ", acc["done"], acc["line"]))).otherwise(acc["done"]).alias("done"), (acc["n"] + F.when(ends, 1).otherwise(0)).alias("n"), F.when(fits, longer).when(ends & (acc["n"] + 1 >= most), F.lit("")).otherwise(w).alias("line"))
        )

    def end(acc: Column) -> Column:
        rest = (acc["line"] != "") & (acc["n"] < most)
        return F.struct(F.when(rest, F.trim(F.concat_ws(" ", acc["done"], acc["line"]))).otherwise(acc["done"]).alias("text"), (acc["n"] + F.when(rest, 1).otherwise(0)).alias("n_lines"))

    return F.aggregate(words, start, lay, end)


def month_range(text: Column, now: Column | None = None) -> Column:
    """struct(first, last) in month indexes: a single date, or the one place where - – — or / parts two; else null.

    A range that is turned round, or that could be parted in two ways, is null.
    """

    def of(t: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t))), lambda i: F.substring(t, i, 1).isin("-", "–", "—", "/"))
        pairs = F.transform(spots, lambda i: F.struct(parse_month(F.substring(t, F.lit(1), i - 1), now).alias("first"), parse_month(F.substring(t, i + 1, F.length(t)), now).alias("last")))
        good = F.filter(pairs, lambda p: p["first"].isNotNull() & p["last"].isNotNull())
        parted = let(good, lambda g: F.when(F.size(g) == 1, F.get(g, F.lit(0))))
        return let(parse_month(t, now), lambda alone: F.when(alone.isNotNull(), F.struct(alone.alias("first"), alone.alias("last"))).otherwise(parted))

    # a text is made once, not once a character
    out = let(text, of)
    return let(out, lambda r: F.when(r["last"] >= r["first"], r))
