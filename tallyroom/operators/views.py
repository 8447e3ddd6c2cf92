"""Views over records: ownership, search filters, quotas, names, counts, evidence, contacts, channels, migrations, proposals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.numbers import round_half_up
from tallyroom.sources.tables import validate


def owned_rows(df: DataFrame, owner: str, who: Column) -> DataFrame:
    """The rows of one owner; nobody (null) owns nothing, and rows without an owner are nobody's.  The filter reaches the scan."""
    return df.where(F.col(owner) == who)


def findable(entities: DataFrame, *, kinds: list[str] | None = None, least: float = 0.0, kind: str = "type", confidence: str = "confidence", status: str = "status", hidden: tuple[str, ...] = ("rejected", "deprecated")) -> DataFrame:
    """Entities that a search may find: of the kinds, sure enough, and of no hidden status.

    A null confidence is 0, a null status hides nothing; without kinds all count.
    """
    out = entities.where((F.coalesce(F.col(confidence), F.lit(0.0)) >= least) & ~F.coalesce(F.col(status).isin(*hidden), F.lit(False)))
    return out if kinds is None else out.where(F.col(kind).isin(*kinds))


def entitlements(people: DataFrame, key: str, quota: str, subscriptions: DataFrame, month: DataFrame, day: DataFrame, none: str = "none") -> DataFrame:
    """(key, status, uses, today, remaining) of each person; four reads joined on the person.

    subscriptions: (key, status), one a person; month, day: rows of uses (key).  No subscription: ``none``; no use: 0;
    what remains of the day's quota is never below 0.  Uses are counted before they are joined.
    """
    uses, today = month.groupBy(key).agg(F.count("*").alias("uses")), day.groupBy(key).agg(F.count("*").alias("today"))
    rows = people.select(key, quota).join(subscriptions.select(key, "status"), key, "left").join(uses, key, "left").join(today, key, "left")
    rows = rows.fillna(0, ["uses", "today"]).fillna(none, ["status"])
    return rows.select(key, "status", "uses", "today", F.greatest(F.lit(0), F.col(quota) - F.col("today")).alias("remaining"))


def canonical_of(words: DataFrame, word: str, labels: DataFrame) -> DataFrame:
    """(word, canonical) of the distinct words: by an alias, of several the one of the least id; else by the name itself; else null.

    labels: (id, alt, canonical).
    """
    by_alt = labels.groupBy(F.col("alt").alias(word)).agg(F.min_by("canonical", F.struct("id", "canonical")).alias("a"))
    by_name = labels.select(F.col("canonical").alias(word), F.col("canonical").alias("b")).distinct()
    return words.select(word).distinct().join(by_alt, word, "left").join(by_name, word, "left").select(word, F.coalesce("a", "b").alias("canonical"))


def unresolved(groups: DataFrame, status: str = "status", open_: tuple[str, ...] = ("open", "triaged")) -> DataFrame:
    """(n): groups that nobody has resolved; a null status is no such."""
    return groups.where(F.col(status).isin(*open_)).agg(F.count("*").alias("n"))


def match_percent(df: DataFrame, by: list[str], matched: Column) -> DataFrame:
    """(by, matched): the share of rows that match, in whole per cent, halves up; null counts as no match."""
    return df.groupBy(*by).agg(round_half_up(100 * F.count_if(matched) / F.count("*")).cast("long").alias("matched"))


def tag_claims(claims: DataFrame, ident: str, tags: str) -> DataFrame:
    """(tag, n_claims, mark, claims): how many claims a tag has, each once, and two marks of which they are.

    mark: the sum and the exclusive or of the ids' hashes, in hexadecimal, equal for equal sets of ids in any order.
    claims: MD5 of the ids in order, comma-joined.  A tag's sorted ids stream through one task, as MD5 has to read them
    so; none are gathered.  Null tags and ids are left out.
    """
    pairs = claims.select(F.col(ident).alias("__id"), F.explode(F.array_distinct(tags)).alias("tag")).where(F.col("__id").isNotNull() & F.col("tag").isNotNull()).distinct()
    rows = pairs.select("tag", F.col("__id").cast("string").alias("id"), "__id").repartition("tag").sortWithinPartitions("tag", "__id").select("tag", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total, mixed, whole = None, 0, 0, 0, hashlib.md5()
        done: list[tuple] = []

        def closed() -> tuple:
            return now, n, f"{total:x}-{mixed:x}", whole.hexdigest()

        for batch in batches:
            for tag, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if tag != now:
                    if n:
                        done.append(closed())
                    now, n, total, mixed, whole = tag, 0, 0, 0, hashlib.md5()
                told = one.encode()
                mark = hashlib.md5(told).hexdigest()
                whole.update(b"," + told if n else told)
                n, total, mixed = n + 1, total + int(mark[:8], 16), mixed ^ int(mark[8:16], 16)
            if done:
                yield _claims(done)
                done = []
        if n:
            yield _claims([closed()])

    return rows.mapInArrow(run, "tag string, n_claims long, mark string, claims string")


def _claims(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tag", "n_claims", "mark", "claims"])


def distinct_names(df: DataFrame, name: Column) -> DataFrame:
    """(n_names): distinct names in any case of letters; null is none.  Counted over two levels, so nothing is gathered."""
    return df.select(F.lower(name).alias("n")).where("n IS NOT NULL").distinct().agg(F.count("*").alias("n_names"))


def calendar_places(df: DataFrame, date: Column, order: list[str], out: str = "place") -> DataFrame:
    """The columns, then the place of a row within its date, from 1, by the order: instant, title, kind."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(date).orderBy(*order)))


def json_document(fields: dict[str, Column]) -> Column:
    """A JSON document of columns; nulls are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def json_element(document: Column, path: str, kind: str) -> Column:
    """What a JSON document holds under a path of names, as a type; null where it is broken, lacks it or holds another."""
    return F.get_json_object(document, f"$.{path}").try_cast(kind)


def flattened(parts: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, source, depth): a row for each row of a profile's parts, with the depth of evidence of its kind.  parts: source to (rows with key, depth)."""
    rows = [df.select(key, F.lit(source).alias("source"), F.lit(depth).alias("depth")) for source, (df, depth) in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def blocking_requirements(findings: DataFrame, by: list[str], rule: str, blocking: Column, confirmed: Column) -> DataFrame:
    """(by, unmet, unconfirmed): blocking rules that are confirmed not to be met, and those of which nothing is known, each once, sorted.

    A null blocking is none; a null confirmation is not confirmed.  An owner has as many rules as there are kinds.
    """
    sure = F.coalesce(confirmed, F.lit(False))
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(rule))))
    return findings.groupBy(*by).agg(some(blocking & sure).alias("unmet"), some(blocking & ~sure).alias("unconfirmed"))


def reading(score: Column, evidence: Column, blocked: Column, bands: list[tuple[float, str]], lowest: str) -> Column:
    """What a score is told as: NO_EVIDENCE, NOT_SCORED, BLOCKED, else the first band whose limit it reaches, else the lowest."""
    out = F.lit(lowest)
    for limit, name in sorted(bands):
        out = F.when(score >= limit, name).otherwise(out)
    return F.when(~F.coalesce(evidence, F.lit(False)), "NO_EVIDENCE").when(score.isNull(), "NOT_SCORED").when(F.coalesce(blocked, F.lit(False)), "BLOCKED").otherwise(out)


#: A post address, and a phone number of 9 to 15 digits.
MAIL, PHONE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "\\+?[0-9](?:[ -]?[0-9]){8,14}"


def text_contacts(docs: DataFrame, text: str, n_chars: str) -> DataFrame:
    """The columns, then n_emails, n_phones, n_blocks (lines that say something) and lost: the text has fewer characters than it had.

    A null text holds nothing; a null count can't tell.
    """
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    blocks = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")).cast("long")
    return docs.withColumns({"n_emails": count(MAIL), "n_phones": count(PHONE), "n_blocks": blocks, "lost": F.length(t) < F.col(n_chars)})


def channel_of(url: Column, channels: list[tuple[str, str]], otherwise: str = "OTHER") -> Column:
    """The channel of the first pattern (pattern, channel) that the lower-cased url meets; a null url meets none."""
    out = F.lit(otherwise)
    for pattern, name in reversed(channels):
        out = F.when(F.lower(url).rlike(pattern), name).otherwise(out)
    return out


def migrated(rows: DataFrame, states: dict[str, str], status: str, defaults: dict[str, Column], rules: dict[str, str]) -> DataFrame:
    """The columns in a newer form, then quarantined: states renamed (unknown ones null), nulls filled by defaults, and the first rule that a row breaks, else empty.

    rules: name to condition; see ``sources.tables.validate``.
    """
    renamed = F.lit(None).cast("string")
    for old, new in states.items():
        renamed = F.when(F.col(status) == old, new).otherwise(renamed)
    filled = rows.withColumn(status, renamed).withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})
    good, bad = validate(filled, rules)
    return good.withColumn("quarantined", F.lit("")).unionByName(bad.select(*filled.columns, F.col("broken_rules")[0].alias("quarantined")))


def proposals(entities: DataFrame, changes: DataFrame, key: str, value: str, guarded: Column) -> DataFrame:
    """(key, state, value): what changes by id come to.

    changes: (key, value), of several of a key the greatest.  PENDING where the entity is guarded: its value stays until
    the change is agreed to; UPDATED; NEW for an id that there is not; SAME without a change.
    """
    new = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("__new"))
    both = entities.withColumns({"__guarded": F.coalesce(guarded, F.lit(False)), "__here": F.lit(True)}).select(key, value, "__guarded", "__here").join(new, key, "full")
    state = F.when(F.col("__here").isNull(), "NEW").when(F.col("__new").isNull(), "SAME").when(F.col("__guarded"), "PENDING").otherwise("UPDATED")
    return both.select(key, state.alias("state"), F.when(state == "PENDING", F.col(value)).otherwise(F.coalesce("__new", value)).alias(value))


def skill_labels(labels: DataFrame, skill: str, label: str, derived: Column, most: int | None = None) -> DataFrame:
    """(skill, n, labels): how many other labels a skill has, each once, derived ones hidden, and which, by name.

    A null ``derived`` hides nothing.  most: of the labels only so many are shown; they are numbered within a skill then,
    so that one with very many gathers no more than it shows.
    """
    one = labels.where(~F.coalesce(derived, F.lit(False))).select(skill, F.lower(label).alias("__l")).where("__l IS NOT NULL").distinct()
    if most is not None:
        one = one.withColumn("__r", F.row_number().over(Window.partitionBy(skill).orderBy("__l")))
    shown = F.col("__l") if most is None else F.when(F.col("__r") <= most, F.col("__l"))
    return one.groupBy(skill).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(shown)).alias("labels"))
