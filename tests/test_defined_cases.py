"""Nulls, empty texts, ties and empty tables of the operators that queries reach with made texts alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import phrases as ph
from tallyroom.functions import rules as ru
from tallyroom.functions import text as tx
from tallyroom.operators import career, learning, offers, profiles
from tallyroom.operators import intervals as iv


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_texts_of_nothing(spark):
    rows = [(None,), ("",)]
    t = F.col("t")
    for column, want in (
        (ph.positive_evidence(t, "python"), False), (ph.phrase_count(t, "x"), 0), (ph.sentence_words(t, ["a"]), []), (ph.said_metrics(t), []), (ph.stack_frames(t), []), (tx.feature_tokens(t), []), (tx.plain_tokens(t), []),
        (career.verb_ratio(t, ["a"]), None), (offers.cleaned_offer(t, "x", "y"), ""), (offers.taxonomy_hits(t, [("a", "b", None)]), []), (ru.injected(t), False), (ru.closed_host(t), True),
    ):
        assert one(spark, column, rows, "t string") == [want, want]
    assert one(spark, learning.meta_features(t), rows, "t string") == [["__meta_low_alpha_ratio__", "__meta_very_short_document__"]] * 2


def test_words_of_other_scripts_stay(spark):
    rows = [("Kovář Šárka",), ("Ωμέγα слово",), ("c++ .net",)]
    assert one(spark, F.array_join(tx.plain_tokens(F.col("t")), " "), rows, "t string") == ["kovar sarka", "ωμεγα слово", "c net"]
    assert one(spark, F.array_join(tx.feature_tokens(F.col("t")), " "), rows, "t string") == ["kovář šárka", "ωμέγα слово", "cpp dotnet"]


def test_repeated_tokens_are_a_burst(spark):
    got = one(spark, F.array_contains(learning.meta_features(F.col("t")), "__meta_repetition_burst__"), [("word " * 5 + "one two three",), ("word " * 4 + "one two three four",), ("a b",)], "t string")
    assert got == [True, False, False]


def test_overlaps_of_long_and_short_intervals(spark):
    rows = [(1, i, 10 * i, 10 * i + 3) for i in range(50)] + [(1, 99, 0, 1000), (1, 98, None, 5), (2, 7, 0, 1000)]
    frame = spark.createDataFrame(rows, "o int, i int, s long, e long")
    want = {(i, 99, 3) for i in range(50)}
    for width in (None, 7, 10**6):
        assert {(r.a, r.b, r.shared) for r in iv.overlaps(frame, ["o"], "s", "e", "i", width).collect()} == want
    assert iv.overlaps(frame.limit(0), ["o"], "s", "e", "i").count() == 0


def test_imports_and_references(spark):
    here = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], "s string, k int, v string")
    new = spark.createDataFrame([("a", 1, "y"), ("a", 2, "y"), ("b", 2, "y"), ("c", 1, "y")], "s string, k int, v string")
    got = sorted(map(tuple, profiles.apply_import(here, new, ["s", "k"], "s", {"b": "replace", "c": "keep"}).collect()))
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("b", 2, "y"), ("c", 1, "x")]
    assert profiles.apply_import(here, new.limit(0), ["s", "k"], "s", {"b": "replace"}).count() == 3
    assert profiles.global_consensus(spark.createDataFrame([("x", "d", None)], "k string, domain string, score double"), ["k"], {"d": 1.0}, F.lit(None).cast("double")).first().score is None


@pytest.mark.parametrize(
    ("text", "hidden", "n"),
    [
        ("Ann [PERSON] a@b.cd, Ann Lee +48 600 700 800; 12 345", "[KANDYDAT_2] [PERSON] [EMAIL], [KANDYDAT] [TELEFON]; 12 345", 4),
        ("write [EMAIL] or a@b.example", "write [EMAIL] or [EMAIL_2]", 1), ("[KANDYDAT] is Ann Lee, [KANDYDAT_7] Ann", "[KANDYDAT] is [KANDYDAT_8], [KANDYDAT_7] [KANDYDAT_9]", 2),
        ("https://a.b/Ann?x=[LINK_3] Ann [TELEFON", "[LINK_4] [KANDYDAT] [TELEFON", 2), ("[EMAIL_2] x@y.zz x@y.zz [EMAIL_99]", "[EMAIL_2] [EMAIL_100] [EMAIL_100] [EMAIL_99]", 1), ("", "", 0),
    ],
)
def test_pseudonyms_come_back(spark, text, hidden, n):
    pair = ph.pseudonyms(F.col("t"), F.array(F.lit("Ann"), F.lit("Ann Lee")))
    (row,) = spark.createDataFrame([(text,)], "t string").select(pair.alias("p")).select("p.*", ph.restored(F.col("p.text"), F.col("p.map")).alias("back")).collect()
    assert (row.text, len(row["map"]), row.back) == (hidden, n, text)


def test_refunds_never_go_below_nothing(spark):
    rows = spark.createDataFrame([("u", i, k) for i, k in enumerate([1, 1, 0, 1, 0, 1, 1, 1])], "u string, i int, refund int")
    got = [r.used for r in career.counter_with_refunds(rows, ["u"], ["i"], F.col("refund") == 1).orderBy("i").collect()]
    assert got == [0, 0, 1, 0, 1, 0, 0, 0]
