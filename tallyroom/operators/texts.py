"""Measures of texts: damage of the encoding, class, numbers' contexts, token agreement, order, answers, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.functions.numbers import clamp
from tallyroom.functions.text import fold, let
from tallyroom.operators.events import ordered_fold

#: Byte pairs of UTF-8 read as a one-byte code.
BROKEN = ("Ã©", "Ã¨", "Ã¤", "Ã¶", "Ã¼", "Ä…", "Ä™", "Å‚", "â€™", "â€œ")


def encoding_damage(docs: DataFrame, text: str) -> DataFrame:
    """The columns, then lexical (letters and digits), damage_mass, damage (mass a lexical character) and encoding (0 to 1).

    A replacement character or a pair of misread bytes weighs 1, a private-use character 0.8 beside a letter or digit,
    else 0.1.  A null text has no damage.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    private = F.regexp_count(body, F.lit("[\\uE000-\\uF8FF]"))
    inside = F.regexp_count(body, F.lit("(?<=[\\p{L}\\p{N}])[\\uE000-\\uF8FF]|[\\uE000-\\uF8FF](?=[\\p{L}\\p{N}])"))
    broken = F.regexp_count(body, F.lit("|".join(BROKEN)))
    mass = F.regexp_count(body, F.lit("\\uFFFD")) + broken + 0.8 * inside + 0.1 * (private - inside)
    lexical = F.regexp_count(body, F.lit("[\\p{L}\\p{N}]")).cast("long")
    out = docs.withColumns({"lexical": lexical, "damage_mass": mass.cast("double")})
    out = out.withColumn("damage", F.col("damage_mass") / F.greatest(F.lit(1), F.col("lexical")))
    return out.withColumn("encoding", clamp(F.exp(-F.col("damage") / 0.008)))


def document_class(text: Column, headings: list[str], contact: str, others: list[str]) -> Column:
    """struct(document_class, confidence): RECORD by headings and contact cues, OTHER by two foreign patterns and no cue, else UNKNOWN."""
    hits = lambda ps: sum((text.rlike(p).cast("int") for p in ps), F.lit(0))
    h, c, o = hits(headings), text.rlike(contact), hits(others)
    other, record = (o >= 2) & (h == 0) & ~c, (h >= 2) | ((h >= 1) & c)
    kind = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "UNKNOWN").when(other, "OTHER").when(record, "RECORD").otherwise("UNKNOWN")
    sure = F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).when(other, F.least(F.lit(0.95), 0.75 + 0.08 * o)).when(record, F.least(F.lit(0.98), 0.70 + 0.08 * h + F.when(c, 0.08).otherwise(0.0))).otherwise(0.45)
    return F.struct(kind.alias("document_class"), sure.alias("confidence"))


#: Words that tell what a number beside them stands for.
DATED = "od|do|since|from|until|obecnie|present|styczeń|luty|marzec|kwiecień|maj|czerwiec|lipiec|sierpień|wrzesień|październik|listopad|grudzień|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
LASTING = "rok|lata|lat|miesiąc|miesiące|miesięcy|tydzień|tygodnie|years?|months?|weeks?"
VERSIONED = "windows|office|m365|o365|s7|v\\.?\\s*[0-9]|version|wersja|release|model|iso|iatf|wcag|http|tls"
ACHIEVED = "zwiększ|wzrost|obniż|zmniejsz|redukc|skróc|oszczęd|popraw|podnies|utrzym|osiągn|pozysk|wdroż|zrealiz|processed|increased|reduced|saved|improved|grew|cut|delivered|achieved"
COUNTED = "klient|użytkownik|pracownik|projekt|transakcj|faktur|zgłosze|ticket|zapyt|rynk|kraj|oddział|lokalizacj|rekord|dokument|zamówie|users?|clients?|employees?|projects?|transactions?|tickets?|requests?"
PAID = "pln|zł|zl|eur|usd|gbp|rub|tys\\.?|mln|mld|k|million|billion"
#: What a number of each class weighs; others weigh nothing.
NUMBER_WEIGHTS = {"IMPACT_METRIC": 1.0, "SCALE_METRIC": 0.55, "UNKNOWN_NUMBER": 0.1}


def number_context(number: Column, window: Column) -> Column:
    """struct(context, confidence, weight): what a number stands for, by the first rule that its surroundings meet.

    Words are bounded by what is no letter, digit or underscore of ASCII.
    """
    # a boundary lies between a word character and another, so its side depends on the sign next to it
    b = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    # every listed word begins with a word character
    before = "(?<![A-Za-z0-9_])"

    def told(low: Column, year: Column) -> Column:
        said = lambda words: low.rlike(f"{before}(?:{words}){b}")
        begun = lambda words: low.rlike(f"{before}(?:{words})")
        flags = F.struct(year.alias("year"), begun(ACHIEVED).alias("impact"), said(PAID).alias("money"), begun(COUNTED).alias("counted"))

        def by_rules(x: Column) -> Column:
            year, impact, money, counted = x["year"], x["impact"], x["money"], x["counted"]
            rules = [
                (year & (low.rlike(f"(?:^|{before})(?:{DATED}){b}") | low.rlike("[-–—/]\\s*(?:19|20)[0-9]{2}")), "DATE_OR_YEAR", 0.98), (said(LASTING) & ~impact, "DURATION", 0.93), (said(VERSIONED) & ~impact, "VERSION_OR_MODEL", 0.9),
                (impact & (money | low.rlike("%|procent")), "IMPACT_METRIC", 0.97), (impact & counted, "IMPACT_METRIC", 0.88), (counted, "SCALE_METRIC", 0.86), (money & low.rlike(f"{before}(?:99|24|7)\\s*(?:zł|zl){b}") & ~impact, "PRICE_OR_NAME_FRAGMENT", 0.82),
                (money, "SCALE_METRIC", 0.78), (year, "DATE_OR_YEAR", 0.82),
            ]
            out = unknown
            for c, name, sure in reversed(rules):
                out = F.when(c, F.struct(F.lit(name).alias("context"), F.lit(sure).alias("confidence"))).otherwise(out)
            return out

        # most numbers are no years and have none of the words beside them
        some = low.rlike(f"{before}(?:(?:{LASTING}|{VERSIONED}|{PAID}){b}|{ACHIEVED}|{COUNTED})")
        return F.when(year | some, let(flags, by_rules)).otherwise(unknown)

    unknown = F.struct(F.lit("UNKNOWN_NUMBER").alias("context"), F.lit(0.45).alias("confidence"))
    year = F.regexp_replace(F.regexp_replace(number, "\\s", ""), ",", ".").rlike("^(?:19|20)[0-9]{2}$")
    given = F.struct(F.lower(F.trim(F.regexp_replace(window, "\\s+", " "))).alias("low"), year.alias("year"))
    weight = lambda x: F.coalesce(*[F.when(x["context"] == n, F.lit(w)) for n, w in NUMBER_WEIGHTS.items()], F.lit(0.0))
    return let(let(given, lambda g: told(g["low"], g["year"])), lambda x: F.struct(x["context"].alias("context"), x["confidence"].alias("confidence"), weight(x).alias("weight")))


def numbers_in_context(docs: DataFrame, key: str, text: str, around: int = 30) -> DataFrame:
    """(key, context, n, confidence, weight): the numbers of each text by context, with the sums of their confidences and weights."""
    # surroundings end with the line, so lines without a number are passed over; what leads up to a number is not tried in part
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike("[0-9]"))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(f"([^0-9\n]{{0,{around}}}+[0-9][0-9.,:]*[^0-9\n]{{0,{around}}})"), 1)))
    rows = docs.select(key, F.explode(found).alias("w")).select(key, number_context(F.regexp_extract("w", "([0-9][0-9.,:]*)", 1), F.col("w")).alias("c")).select(key, "c.*")
    return rows.groupBy(key, "context").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.sum("weight").alias("weight"))


def token_agreement(left: DataFrame, right: DataFrame, key: list[str], token: str) -> DataFrame:
    """(key, n_left, n_right, n_shared, precision, recall, f1) of two bags of tokens (key, token)."""
    a, b = left.groupBy(*key, token).agg(F.count("*").alias("a")), right.groupBy(*key, token).agg(F.count("*").alias("b"))
    out = a.join(b, [*key, token], "full").groupBy(*key).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_right"), F.coalesce(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b"))), F.lit(0)).alias("n_shared"))
    return _with_f1(out)


def bag_overlap(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, n_shared): the sizes of the intersections of all pairs of bags that share a token."""
    a, b = left.groupBy(left_key, on).agg(F.count("*").alias("a")), right.groupBy(right_key, on).agg(F.count("*").alias("b"))
    return a.join(b, on).groupBy(left_key, right_key).agg(F.sum(F.least("a", "b")).alias("n_shared"))


def _with_f1(df: DataFrame) -> DataFrame:
    p, r = F.col("n_shared") / F.nullif(F.col("n_right"), F.lit(0)), F.col("n_shared") / F.nullif(F.col("n_left"), F.lit(0))
    out = df.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def order_discordance(df: DataFrame, by: list[str], first: str, second: str, weight: str | None = None) -> DataFrame:
    """(by, comparable, discordant, discordance): the weight of pairs that two orders put the other way round.

    A pair weighs as the lighter of its rows; pairs that are equal in one order aren't comparable.  The weight of all
    pairs is the sum, over the distinct weights, of what a weight adds to the next lower one times the pairs of rows that
    weigh as much: so pairs are counted, never formed, once a distinct weight.  Rows with a null are left out; those of
    a weight of 0 or less weigh nothing.  An owner's rows go by in the first order, one layer of weight after the other.
    """
    rows = df.select(*by, F.col(first).alias("f"), F.col(second).alias("s"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("f IS NOT NULL AND s IS NOT NULL AND w > 0")
    # places in the second order are dense ranks, so that counts by place fit an array
    places = F.dense_rank().over(Window.partitionBy(*by).orderBy("s")) - 1
    if weight is None:
        layered = rows.withColumns({"rank": places, "layer": F.lit(1.0), "step": F.lit(1.0)})
    else:
        layers = rows.select(*by, F.col("w").alias("layer")).distinct()
        layers = layers.withColumn("step", F.col("layer") - F.coalesce(F.lag("layer").over(Window.partitionBy(*by).orderBy("layer")), F.lit(0.0)))
        layered = rows.withColumn("rank", places).join(layers, by).where("w >= layer")
    counted = ordered_fold(layered.select(*by, "layer", "step", "f", "rank"), [*by, "layer"], ["f"], "rank", pair_rule, "n", also=("f", "rank"), kind=T.ArrayType(T.LongType()))
    out = counted.groupBy(*by).agg(F.sum(F.col("n")[0] * F.col("step")).alias("comparable"), F.sum(F.col("n")[1] * F.col("step")).alias("discordant")).where("comparable > 0")
    return out.withColumn("discordance", F.col("discordant") / F.col("comparable"))


def pair_rule(state: dict, _: object, f, rank: int) -> list[int]:
    """Of the rows before, with another place in both orders: how many, and how many that the second order puts after.

    Counts by place are a tree of sums (each cell holds those of a power of two of places before it), so a row costs the
    logarithm of the places.
    """
    tree, wait = state.setdefault("tree", [0]), state.setdefault("wait", [])

    def upto(place: int) -> int:
        """Rows at places below ``place``."""
        place, n = min(place, len(tree) - 1), 0
        while place > 0:
            n += tree[place]
            place &= place - 1
        return n

    if state.get("f", f) != f:  # rows of one place wait for the next
        for place in wait:
            while len(tree) <= place + 1:  # a new cell holds what its range has
                k, n, below = len(tree), 0, len(tree) - 1
                while below > (k & (k - 1)):
                    n += tree[below]
                    below &= below - 1
                tree.append(n)
            place += 1
            while place < len(tree):
                tree[place] += 1
                place += place & -place
            state["total"] = state.get("total", 0) + 1
        wait.clear()
    state["f"] = f
    wait.append(rank)
    total, before, through = state.get("total", 0), upto(rank), upto(rank + 1)
    return [before + total - through, total - through]


def answer_marks(text: Column) -> Column:
    """struct of an answer's marks: n_words, n_numbers, n_questions, n_i, n_we and has_result."""
    low = fold(F.coalesce(text, F.lit("")))
    count = lambda p: F.regexp_count(low, F.lit(p)).cast("long")
    said = lambda *words: F.size(F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t.isin(*words))).cast("long")
    return F.struct(count("[^ \\t\\n\\r]+").alias("n_words"), count("[0-9]+").alias("n_numbers"), count("\\?").alias("n_questions"), said("i", "me", "my").alias("n_i"), said("we", "us", "our").alias("n_we"), low.rlike("[0-9]+ ?%|result|increas|reduc|sav").alias("has_result"))


def sections(docs: DataFrame, key: str, text: str, headers: dict[str, str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, line, section, content): each line under the last header at or before it; headers: name to a pattern on a whole line.

    ignored: names of sections that are left out with all their lines, up to the next header.

    Headers part a text's array of lines; each part is a slice of it, so nothing is shuffled or grows line by line.
    """
    name = F.lit(None).cast("string")
    kind = lambda x: _first_match(x, headers, name)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def parted(x: Column) -> Column:
        heads = F.filter(F.transform(x, lambda t, i: F.struct(i.alias("line"), kind(F.lower(F.trim(t))).alias("header"))), lambda h: h["header"].isNotNull())
        return let(F.concat(F.array(F.struct(F.lit(0).alias("line"), name.alias("header"))), heads), lambda h: F.flatten(F.transform(h, lambda s, j: part(x, s, F.coalesce(F.get(h, j + 1)["line"], F.size(x))))))

    def part(x: Column, s: Column, end: Column) -> Column:
        return F.transform(F.slice(x, s["line"] + 1, end - s["line"]), lambda t, i: F.struct((s["line"] + i).alias("line"), s["header"].alias("section"), t.alias("content")))

    kept = lambda rows: F.filter(rows, lambda r: ~F.coalesce(r["section"].isin(*ignored), F.lit(False))) if ignored else rows
    return docs.select(key, F.explode(kept(let(lines, parted))).alias("r")).select(key, "r.*")


def _first_match(x: Column, patterns: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for name, p in reversed(list(patterns.items())):
        out = F.when(x.rlike(p), F.lit(name)).otherwise(out)
    return out


def unknown_terms(said: Column, known: Column) -> Column:
    """Members of an array of terms that an array of known ones lacks, folded, sorted."""
    low = lambda a: F.transform(a, lambda t: F.lower(F.trim(t)))
    return F.array_sort(F.array_except(low(said), low(known)))


def unknown_counts(said: DataFrame, known: DataFrame, key: str, term: str) -> DataFrame:
    """(key, n_unknown): distinct terms that a key's rows say and its known rows lack, folded by case and outer spaces; keys that have both.

    Terms are rows throughout: no key's texts come together.
    """
    plain = lambda df: df.select(key, F.lower(F.trim(F.col(term))).alias("t")).where(F.col("t").isNotNull()).distinct()
    a, b = plain(said), plain(known)
    both = a.select(key).distinct().join(b.select(key).distinct(), key)
    lost = a.join(b, [key, "t"], "left_anti").groupBy(key).agg(F.count("*").alias("n_unknown"))
    return both.join(lost, key, "left").select(key, F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))
