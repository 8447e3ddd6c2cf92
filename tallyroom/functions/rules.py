"""Predicates and small decision tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.numbers import clamp

#: Networks that a fetch must not reach: base, prefix length.
CLOSED = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: Names and ends of names that no public host has.
CLOSED_NAMES, CLOSED_ENDS = ("localhost", "metadata.google.internal", "metadata", "instance-data"), (".local", ".internal", ".localhost", ".home.arpa", ".cluster.local")


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none, or if a part has a leading zero, which some read as octal."""
    p = F.split(ip, "\\.")
    good = ip.rlike("^(?:0|[1-9][0-9]{0,2})(?:\\.(?:0|[1-9][0-9]{0,2})){3}$") & F.forall(p, lambda x: x.try_cast("int") <= 255)
    return F.when(good, reduce(lambda n, i: n * 256 + F.get(p, i).try_cast("long"), range(4), F.lit(0).cast("long")))


def ip_groups(ip: Column) -> Column:
    """The eight numbers of an IPv6 address, :: for as many zeros as are left; null if it is none, or has dotted parts."""
    low = F.split(F.lower(ip), "%")[0]

    def of(x: Column) -> Column:
        halves = F.split(x, "::")
        parts = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        n = F.size(parts(0)) + F.size(parts(1))
        filled = F.concat(parts(0), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), parts(1))
        good = ((F.size(halves) == 1) & (n == 8)) | ((F.size(halves) == 2) & (n <= 8))
        return F.when(good & F.forall(filled, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(filled, lambda g: F.conv(g, 16, 10).cast("long")))

    return F.when(low.contains(":"), F.transform(F.array(low), of)[0])


def closed_number(n: Column, networks: tuple = CLOSED) -> Column:
    low = lambda b: reduce(lambda x, y: x * 256 + int(y), b.split("."), 0)
    return reduce(lambda x, y: x | y, [n.between(low(b), low(b) + 2 ** (32 - k) - 1) for b, k in networks])


def closed_address(ip: Column, networks: tuple = CLOSED) -> Column:
    """Whether an address lies in a closed network; what is no address is closed too.

    An IPv6 address with an IPv4 one in it (mapped, or by a translator's prefix) is judged by that.
    """

    def of(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        zero = lambda n: reduce(lambda x, y: x & y, [at(i) == 0 for i in range(n)])
        inner = at(6) * 65536 + at(7)
        mapped = (zero(5) & (at(5) == 65535)) | ((at(0) == 0x64) & (at(1) == 0xFF9B) & (at(2) == 0) & (at(3) == 0) & (at(4) == 0) & (at(5) == 0))
        other = zero(7) & (at(7) <= 1)
        for mask, value in ((0xFE00, 0xFC00), (0xFFC0, 0xFE80), (0xFF00, 0xFF00)):
            other = other | (at(0).bitwiseAND(F.lit(mask)) == value)
        return F.when(mapped, closed_number(inner, networks)).otherwise(other | ((at(0) == 0x2001) & (at(1) == 0x0DB8)))

    v6 = F.transform(F.array(ip_groups(ip)), of)[0]
    return F.coalesce(F.when(ip.contains(":"), v6).otherwise(closed_number(ip_number(ip), networks)), F.lit(True))


def closed_host(host: Column) -> Column:
    """Whether a host's name is one that only stands within a network: listed, by its end, or of a single label; empty too."""
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), "\\.$", "")
    return (h == "") | h.isin(*CLOSED_NAMES) | reduce(lambda x, y: x | y, [F.endswith(h, F.lit(e)) for e in CLOSED_ENDS]) | ~(h.contains(".") | h.contains(":"))


def has_metric(text: Column) -> Column:
    """A measurable result: a share, money, a factor or a count with a unit; what stands in brackets is an example."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\[[^\\]]*\\]", " ")
    return bare.rlike("[0-9]+(?:[.,][0-9]+)? ?%|[$€£] ?[0-9]|[0-9] ?(?:usd|eur|pln|gbp)|[0-9]+ ?x[^a-z]|[0-9]+[+]|[0-9]+ (?:people|users|clients|projects|hours|days|months|years)")


def compare(required: Column, actual: Column, operator: Column) -> Column:
    """Fulfilment 0 to 1 of at_least (in proportion), more_than, at_most and less_than; null without both numbers."""
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    at_least = F.when(required <= 0, 1.0).otherwise(clamp(actual / F.nullif(required, F.lit(0))))
    out = F.when(operator == "more_than", yes(actual > required)).when(operator == "at_most", yes(actual <= required)).when(operator == "less_than", yes(actual < required)).otherwise(at_least)
    return F.when(required.isNotNull() & actual.isNotNull(), out)


def rank_fulfilment(required: Column, actual: Column) -> Column:
    """Of ordinal levels: reached 1, one short 0.45, two short 0.15, else 0."""
    short = required - actual
    return F.when(short <= 0, 1.0).when(short == 1, 0.45).when(short == 2, 0.15).when(short.isNotNull(), 0.0)


def enough_text(sections: Column) -> Column:
    """Ten letters in all, and one section of 20 characters and two words, or two sections that aren't empty."""
    filled = F.filter(sections, lambda s: F.trim(s) != "")
    letters = F.length(F.regexp_replace(F.array_join(filled, ""), "[^\\p{L}]", ""))
    long = F.exists(filled, lambda s: (F.length(F.trim(s)) >= 20) & F.trim(s).contains(" "))
    return (letters >= 10) & (long | (F.size(filled) >= 2))


def enough_texts(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, enough): the same of a key's rows, each a section; null texts are empty.  Only counts come together."""
    t = F.coalesce(F.col(text), F.lit(""))
    filled = F.trim(t) != ""
    out = df.groupBy(*by).agg(
        F.sum(F.length(F.regexp_replace(t, "[^\\p{L}]", ""))).alias("letters"), F.bool_or(filled & (F.length(F.trim(t)) >= 20) & F.trim(t).contains(" ")).alias("long"), F.count_if(filled).alias("n")
    )
    return out.select(*by, ((F.col("letters") >= 10) & (F.col("long") | (F.col("n") >= 2))).alias("enough"))


def applicability(enabled: Column, healthy: Column, lacking_required: Column, lacking_optional: Column) -> Column:
    """DISABLED, BLOCKED, INSUFFICIENT, PARTIAL or FULL, the first that holds; lacking: arrays of codes."""
    return F.when(~enabled, "DISABLED").when(~healthy, "BLOCKED").when(F.size(lacking_required) > 0, "INSUFFICIENT").when(F.size(lacking_optional) > 0, "PARTIAL").otherwise("FULL")


def real_hourly(net_month: Column, hours_week: float, commute_hours_day: Column, cost_month: Column, days_week: float = 5.0) -> Column:
    """Pay of an hour when the way to work is work too and its cost is taken off; no hours: null."""
    hours = (hours_week + commute_hours_day * days_week) * 52 / 12
    return (net_month - cost_month) / F.nullif(hours, F.lit(0.0))


def variant_of(text: Column, n: int) -> Column:
    """A stable choice of 0 to n - 1: 31 h + c over the characters in 32 bits, as a signed number, its size modulo n."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(2**32))
    return F.abs(F.when(h >= 2**31, h - F.lit(2**32)).otherwise(h)) % n


def row_signature(*columns: str) -> Column:
    """20 hex digits of the named columns in the order of their names; null differs from an empty text."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))) for c in sorted(columns)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def mapped_status(status: Column, states: dict[str, str], otherwise: str) -> Column:
    """A fine status as one of a few states; an unknown or null one is ``otherwise``."""
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in states.items()], F.lit(otherwise))


def status_matches(status: Column, wanted: str, states: dict[str, str] | None = None) -> Column:
    """Whether a row passes the filter: ALL, else an equal status, or with ``states`` one that maps to what is wanted."""
    if wanted == "ALL":
        return F.lit(True)
    names = [k for k, v in (states or {}).items() if v == wanted] or [wanted]
    return F.coalesce(status.isin(*names), F.lit(False))


def tagged(tags: Column, wanted: list[str], texts: list[Column] = (), search: str = "") -> Column:
    """Any of the wanted tags, and the search within a text or a tag; letters in any case, nothing asked: all."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    hit = F.arrays_overlap(low, F.array(*[F.lit(t.lower()) for t in wanted])) if wanted else F.lit(True)
    if search.strip():
        q = F.lit(search.lower())
        hit = hit & reduce(lambda x, y: x | y, [F.coalesce(F.contains(F.lower(t), q), F.lit(False)) for t in texts], F.exists(low, lambda t: F.contains(t, q)))
    return F.coalesce(hit, F.lit(False))


def valid_score(score: Column) -> Column:
    """A finite number from 0 to 100; null is none."""
    return F.coalesce(score.between(0, 100) & ~F.isnan(score), F.lit(False))


#: What tells that work can be done from elsewhere, or in part.
FLEXIBLE = "zdaln[a-ząćęłńóśźż]*|remote|hybryd[a-ząćęłńóśźż]*|hybrid|home\\s*office|teleprac[a-ząćęłńóśźż]*|b2b|freelance|kontrakt|zlecenie|dorywcz[a-ząćęłńóśźż]*|part-time|p[oó]ł\\s*etatu"


def flexible_work(*texts: Column) -> Column:
    body = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return body.rlike(f"(?<![a-z0-9_])(?:{FLEXIBLE})(?![a-z0-9_])")


def freshness(made_for: Column, current: Column, made_by: Column, rules: Column, month: Column, now: Column) -> Column:
    """stale, unknown or current of a result: by the data's revision, then the rules' version, then the month it was made in.

    A difference that is known comes before what is not known.
    """
    revision = F.when(made_for.isNotNull() & current.isNotNull() & (made_for != current), "stale")
    version = F.when(made_by.isNotNull() & (made_by != rules), "stale")
    unknown = F.when(made_for.isNull() | current.isNull() | made_by.isNull(), "unknown")
    time = F.when(month.isNull(), "unknown").when(month != now, "stale").otherwise("current")
    return F.coalesce(revision, version, unknown, time)


def masked_words(text: Column, listed: list[str]) -> Column:
    """struct(n_listed, masked): words between white space that are listed, signs aside, as three stars."""
    words = F.split(text, "\\s+")
    bad = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9ąćęłńóśźż]", "").isin(*listed)
    return F.struct(F.size(F.filter(words, bad)).cast("long").alias("n_listed"), F.array_join(F.transform(words, lambda w: F.when(bad(w), "***").otherwise(w)), " ").alias("masked"))


def injected(text: Column) -> Column:
    """A text that brings a script."""
    return F.coalesce(text.rlike("(?i)<script|javascript:"), F.lit(False))


def licence_fulfilment(held: Column, required: Column, covers: tuple[tuple[str, str], ...] = (("CE", "C"), ("DE", "D"), ("BE", "B"))) -> Column:
    """1 for the licence itself or one that covers it, else 0."""
    over = reduce(lambda x, y: x | y, [(held == a) & (required == b) for a, b in covers])
    return F.when((held == required) | over, 1.0).when(held.isNotNull() & required.isNotNull(), 0.0)


def _level(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike(f"(?<![a-z0-9_])(?:{p})(?![a-z0-9_])"), F.lit(name)) for name, p in rules])


#: Words of a level, in the order in which they are looked for, over folded texts.
LANGUAGE = [("NATIVE", "native|ojczysty|mother tongue"), ("C1", "fluent|biegly|biegla|proficient"), ("B2", "advanced|zaawansowany|zaawansowana"), ("B1", "intermediate|srednio zaawansowany|komunikatywny|communicative"), ("A2", "basic|podstawowy|podstawowa")]
EDUCATION = [
    ("DOCTORATE", "phd|doctorate|doctoral|doktor|doktorat"), ("MASTER", "master|msc|magister|magisterskie"), ("BACHELOR", "bachelor|bsc|licencjat|licencjackie|inzynier|inzynierskie"),
    ("SECONDARY", "secondary|srednie|matura|liceum|technikum"), ("VOCATIONAL", "vocational|zawodowe|szkola zawodowa"), ("PRIMARY", "primary|podstawowe"), ("BACHELOR", "higher education|wyksztalcenie wyzsze|university degree"),
]
DRIVING = "(AM|A1|A2|A|B1|B|C1|C|D1|D|BE|CE|DE|T)(?![A-Z0-9_])"


def language_level(folded: Column) -> Column:
    """A1 to C2 where the text names it, else by words; null where it says nothing."""
    direct = F.upper(F.regexp_extract(folded, "(?<![a-z0-9_])([abc][12])(?![a-z0-9_])", 1))
    return F.coalesce(F.nullif(direct, F.lit("")), _level(folded, LANGUAGE))


def education_level(folded: Column) -> Column:
    return _level(folded, EDUCATION)


def driving_category(text: Column) -> Column:
    """A licence's category after the word for category, or for the licence."""
    up = F.upper(text)
    return F.coalesce(F.nullif(F.regexp_extract(up, f"(?:KAT(?:EGORIA)?\\.?\\s*|CATEGORY\\s*)(?<![A-Z0-9_]){DRIVING}", 1), F.lit("")), F.nullif(F.regexp_extract(up, f"PRAWO\\s+JAZDY[^A-Z0-9]{{0,8}}{DRIVING}", 1), F.lit("")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a noun after a number: one, 2 to 4 but not 12 to 14, all others."""
    a = F.abs(n)
    return F.when(a == 1, one).when((a % 10).between(2, 4) & ~(a % 100).between(12, 14), few).otherwise(many)


def percentage(x: Column) -> Column:
    """A share from 0 to 100, rounded half up; what is out of range is no measurement and null."""
    return F.when(valid_score(x), F.floor(x + 0.5).cast("long"))


def claim_depth(depth: Column, strength: Column, floor: float = 0.5) -> Column:
    """A depth that the strength of the claim lowers; null where the claim is too weak to count."""
    c, d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), depth))
    wanted = c * (floor + (1 - floor) * d)
    return F.when(c >= 1 - 1e-9, depth).when(wanted >= floor, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (wanted - floor) / (1 - floor))))
