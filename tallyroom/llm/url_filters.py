"""URL filters: stated rules first, then association rules mined from labelled urls; DataFrame functions only.

FP-growth finds combinations of url tokens that go with a label.  Rules with enough support and confidence are kept,
and a rule is dropped where a rule on fewer of its tokens is as confident.  An inverted index lists each rule under its
rarest token; a url's tokens look rules up there, and a rule fits where the url has all its tokens.

Tokens that stand on the very same labelled urls are mined as one, since k of them would make 2^k sets that say the
same; a url with any of them has that one.  A token on every labelled url is left out: beside others it changes no count,
so the rule without it says as much.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import ascii_lower, broadcast_if, without, written

#: (action, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BAD = "label=bad"
#: Token sets with a mined rule that may be sent to all executors, some 100 bytes each.
BROADCAST_SETS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased.  Path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls; of equal length the first by text."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def url_tokens(url: Column) -> Column:
    """Distinct lower-case words of a url with their place: host label, path segment or query key.

    A word has a letter, and no three digits in a row: those are identifiers, each of which is on a page or few.
    """
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)

    def parts(text: Column, split: str, kind: str) -> Column:
        return F.transform(F.filter(F.split(F.lower(text), split), lambda t: t.rlike("[a-z]") & ~t.rlike("[0-9]{3}")), lambda t: F.concat(F.lit(kind), t))

    return F.array_distinct(F.concat(parts(host, "\\.", "h:"), parts(path, "[/.]", "p:"), parts(F.regexp_replace(query, "=[^&]*", ""), "&", "q:")))


def token_groups(tokens: DataFrame, min_support: float) -> DataFrame:
    """(token, name): tokens on at least min_support of the rows but not on all, by name of those on the same rows.

    Rows are told apart by a hash of their tokens, which equal rows share, and which all tokens of a row then count.
    At most as many tokens as a row holds over min_support.
    """
    total = tokens.count()
    seen = tokens.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").cast("decimal(20,0)").alias("row"))
    seen = seen.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows"))
    seen = seen.where((F.col("n") >= math.ceil(total * min_support)) & (F.col("n") < total))
    return seen.groupBy("n", "rows").agg(F.min("token").alias("name"), F.collect_list("token").alias("tokens")).select(F.explode("tokens").alias("token"), "name")


def renamed(sets: DataFrame, key: str, tokens: str, groups: DataFrame) -> DataFrame:
    """(key, names): the names of the groups that a key's tokens belong to, where there is one."""
    return sets.select(key, F.explode(tokens).alias("token")).join(F.broadcast(groups), "token").groupBy(key).agg(F.collect_set("name").alias("names"))


def mined_rules(tokens: DataFrame, bad: str = "bad", min_support: float = 0.005, min_confidence: float = 0.5) -> DataFrame:
    """(rule_tokens, n_tokens, confidence, support, rarest) mined from rows (tokens, bad).

    min_support is a share of the labelled rows.  No labelled rows: no rules.  A rule is dropped where one on fewer of its
    tokens is as confident.  That is found size by size: a set's best shorter confidence is the greatest of those of its
    sets with one token less, and of theirs, so each set meets as many others as it has tokens.
    """
    marked = tokens.select(F.array_distinct(F.concat("tokens", F.when(F.col(bad), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(marked)
    total = marked.count()
    sets = model.freqItemsets.select(F.sort_array(F.array_except("items", F.array(F.lit(BAD)))).alias("rule_tokens"), F.array_contains("items", BAD).alias("bad"), "freq").where("size(rule_tokens) > 0")
    # every set with the label is one without it as well
    sets = sets.groupBy("rule_tokens").agg(F.max(F.when(F.col("bad"), F.col("freq"))).alias("both"), F.max(F.when(~F.col("bad"), F.col("freq"))).alias("freq"))
    sets = written(sets.select("rule_tokens", F.size("rule_tokens").alias("n_tokens"), "freq", (F.coalesce("both", F.lit(0)) / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(max(total, 1))).alias("support")))
    most = sets.agg(F.max("n_tokens")).first()[0] or 0
    found, below = None, None
    for n in range(1, most + 1):
        here = sets.where(F.col("n_tokens") == n)
        if below is None:
            here = here.withColumn("short", F.lit(-1.0))
        else:
            less = here.select("rule_tokens", F.explode(F.transform("rule_tokens", lambda t: F.array_remove(F.col("rule_tokens"), t))).alias("less"))
            best = less.join(below, "less").groupBy("rule_tokens").agg(F.max("top").alias("short"))
            here = written(here.join(best, "rule_tokens"))
        below = here.select(F.col("rule_tokens").alias("less"), F.greatest("short", "confidence").alias("top"))
        kept = here.where((F.col("confidence") >= min_confidence) & F.col("support").isNotNull() & (F.col("confidence") > F.col("short")))
        found = kept if found is None else found.unionByName(kept)
    if found is None:
        return sets.withColumn("rarest", F.lit("")).select("rule_tokens", "confidence", "support", "n_tokens", "rarest")
    single = sets.where("n_tokens = 1").select(F.col("rule_tokens")[0].alias("token"), "freq")
    rarest = found.select("rule_tokens", F.explode("rule_tokens").alias("token")).join(single, "token").groupBy("rule_tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return found.select("rule_tokens", "confidence", "support", "n_tokens").join(rarest, "rule_tokens")


def best_rule(rows: DataFrame, key: str, tokens: str, rules: DataFrame) -> DataFrame:
    """(key, confidence, rule_tokens) of the most confident rule that fits each row's tokens, where one does."""
    index = rules.select(F.col("rarest").alias("token"), "rule_tokens", "confidence", "n_tokens")
    looked_up = rows.select(key, F.col(tokens).alias("__tokens"), F.explode(tokens).alias("token")).join(index, "token")
    fit = looked_up.where(F.size(F.array_except("rule_tokens", "__tokens")) == 0)
    best = fit.groupBy(key).agg(F.max(F.struct("confidence", (-F.col("n_tokens")).alias("short"), F.array_join("rule_tokens", " ").alias("mined"))).alias("best"))
    return best.select(key, "best.confidence", "best.mined")


def url_filter(pages: DataFrame, labelled: DataFrame, *, url: str = "url", keep: list[str] | None = None, rules: list[tuple[str, str, str]] = RULES, min_support: float = 0.005, min_confidence: float = 0.5, broadcast_sets: int = BROADCAST_SETS) -> DataFrame:
    """The columns (or ``keep``), then host, path, rule, mined, confidence and verdict (block or allow).

    labelled: (url, bad boolean).  The verdict is that of the longest stated rule that fits; where none does, block if
    a mined rule fits, else allow.  A null url or one without :// has an empty host and path, fits no stated rule and
    is allowed.  Sets of tokens are judged once each, then joined to all their rows; clashing columns are replaced.
    """
    made = ["host", "path", "rule", "mined", "confidence", "verdict"]
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in made]
    learned = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(url_tokens(F.col("url")).alias("tokens"), "bad")
    learned = written(learned)
    groups = written(token_groups(learned, min_support))
    # equal sets of tokens have equal names: named once each
    names = written(renamed(learned.select(F.col("tokens").alias("__set")).distinct(), "__set", "__set", groups))
    names = broadcast_if(names, broadcast_sets)  # else shuffled, where a common set's partition is split
    learned = learned.join(names, learned["tokens"] == names["__set"], "left").select(F.coalesce("names", F.array().cast("array<string>")).alias("tokens"), "bad")
    mined = mined_rules(learned, min_support=min_support, min_confidence=min_confidence)
    sets = pages.select(F.array_sort(url_tokens(F.col(url))).alias("__set")).where(F.size("__set") > 0).distinct()
    best = best_rule(renamed(sets, "__set", "__set", groups), "__set", "names", mined)
    best = written(best)
    if best.count() <= broadcast_sets:  # else shuffled, where a common set's partition is split
        best = F.broadcast(best)
    host, path = host_and_path(F.col(url))
    rule, action = stated_rule(F.col("host"), F.col("path"), rules)
    base = without(pages, [n for n in made if n != url]).withColumns({"host": host, "path": path, "__set": F.array_sort(url_tokens(F.col(url)))})
    out = base.withColumns({"rule": rule, "__action": action}).join(best, "__set", "left")
    verdict = F.coalesce(F.col("__action"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).select(*[f"`{c}`" for c in kept], *made)
