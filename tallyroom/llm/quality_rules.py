"""Host-level quality rules, in DataFrame functions only.

Each document is measured; rule failures are counted by host; the host's failure rate is shrunk by a beta prior that
is fitted to all hosts by moments; the host's verdict is joined back to its documents.  Texts are read once: the
measures, a few numbers a row, are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import let, space_words, without, written

SYMBOLS = "[#*$%&|<>]"
#: Hosts whose rates may be sent to all executors, some 40 bytes each.
BROADCAST_HOSTS = 250_000
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "host_failed", "kept"]


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more; first occurrences count.

    Windows of one text are told apart by a 64-bit hash of their words.
    """

    def covered(windows: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        again = F.filter(windows, lambda x, i: same(x, F.get(windows, i - 1)) | same(x, F.get(windows, i + 1)))
        starts = F.sort_array(F.transform(again, lambda x: x["at"]))
        # each window adds the words that the one before it hasn't covered
        first = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(width), s - acc["last"])).alias("n")), lambda acc: acc["n"].cast("long"))

    def of_hashes(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, covered))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) > width, let(hashes, of_hashes)).otherwise(F.lit(0).cast("long"))

    return of(words)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); of null and empty texts 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # the words are split off once for all that is counted of them
    of_words = let(
        space_words(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_window_words(w).alias("again")),
    )
    out = without(docs, [n for n in NAMES if n != text]).withColumn("__w", of_words)
    return out.withColumns(
        {
            "n_words": F.col("__w.n"),
            "word_chars": F.col("__w.chars"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("__w.again"),
        }
    ).drop("__w")


def host_rates(base: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, host_rate) by host that isn't null.

    Prior by the method of moments over hosts, each weighing as its documents: mean m and variance v of the rates, from
    which the sampling variance is taken off; strength a + b = m(1-m)/v - 1, kept between 1 and 1000.  host_rate =
    (n_failed + m * strength) / (n_docs + strength).  Where all rates are equal the strength is 1000.
    """
    by_host = base.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    total = by_host.agg(F.sum("n_docs").alias("n"), F.count("*").alias("k"), (F.sum("n_failed") / F.sum("n_docs")).alias("m"), (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs")).alias("s"))
    spread = F.greatest(F.lit(0.0), F.col("s") - F.col("m") * F.col("m"))
    chance = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.lit(1e-12), spread - chance * F.col("k") / F.col("n"))
    prior = total.select("m", F.least(F.lit(1000.0), F.greatest(F.lit(1.0), chance / between - 1)).alias("strength"))
    m, strength = prior.select("m").scalar(), prior.select("strength").scalar()
    return by_host.select(host, "n_docs", "n_failed", ((F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)).alias("host_rate"))


def quality_rules(docs: DataFrame, *, text: str = "text", host: str = "source", keep: list[str] | None = None, min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.5, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The columns (or ``keep``), then the measures, base_failed, host_rate, host_failed and kept.

    base_failed: n_words < min_words, or 100 * n_repeat_words > max_repeat_percent * n_words.  host_failed: the host's
    shrunk failure rate is over max_host_rate.  kept: neither.  Rows with a null host have a null rate and are judged
    by the base rules alone.  Repeated rows count each; columns with a result's name are replaced; no rows give none.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NAMES]
    base = measured(docs, text).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    base = written(base.select(*dict.fromkeys([*[f"`{c}`" for c in kept], f"`{host}`", *NAMES[:6]])))
    rates = written(host_rates(base, host, "base_failed").select(F.col(host).alias("__host"), "host_rate"))
    if rates.count() <= broadcast_hosts:  # else shuffled, where a hot host's partition is split
        rates = F.broadcast(rates)
    out = base.join(rates, base[host] == F.col("__host"), "left").withColumn("host_failed", F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).select(*[f"`{c}`" for c in kept], *NAMES)
