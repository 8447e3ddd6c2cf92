"""What a task holds and does at size, told by plans, partitions and small odd tables."""

from __future__ import annotations

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyroom.functions.text import plain_tokens
from tallyroom.operators import blocks as bl
from tallyroom.operators import dictionary as di
from tallyroom.operators import records as rc
from tallyroom.operators import texts as ts
from tallyroom.operators.tables import parts_for
from tallyroom.plans import career

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    """The plan as it was run at last."""
    df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().split("== Initial Plan ==")[0]


def test_parts_grow_with_rows(spark):
    assert [parts_for(spark.range(n), 10) for n in (0, 40, 41, 995)] == [4, 4, 5, 100]


def test_role_scores_deal_words_once(spark):
    signals = spark.createDataFrame([("a", "x", "g", 4.0, ["p", "q"]), ("b", "y", "g", 5.0, ["p", "p"])], "role string, signal string, variants string, weight double, stems array<string>")
    words = spark.createDataFrame([(k, w) for k in range(50) for w in ("p", "p", "z", "q" if k % 2 else "r")] + [(None, "p"), (7, None)], "o long, w string")
    found = rc.role_scores(words, signals, "o", "w", parts=7)
    assert len(re.findall("Exchange hashpartitioning", plan(found))) == 1 and found.rdd.getNumPartitions() == 7
    rows = {(r.o, r.role, r.score, r.rank) for r in found.collect()}
    assert rows == {(k, "a", 8.0, 1) for k in range(1, 50, 2)} | {(k, "b", 5.0, 1 + k % 2) for k in range(50)} | {(None, "b", 5.0, 1)}


def test_points_are_dealt_in_parts(spark):
    ranked = career.point_relevance(spark, FOLDER)
    # lines and orders; no step behind them deals anew
    assert len(re.findall("Exchange hashpartitioning.*REPARTITION_BY_NUM", plan(ranked))) == 2
    assert not re.search("Exchange hashpartitioning.*ENSURE", plan(ranked))


def test_longest_phrase_in_tasks_and_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "b c d e"), (2, "d"), (3, "x y"), (4, ""), (5, None), (None, "c d a b")], "k long, t string")
    phrases = spark.createDataFrame([("c d", "2"), ("a b", "1"), ("b c d e", "9"), ("b c d e", "8"), ("d", None), ("d", "z"), (None, "n"), ("a b c d e f", "6")], "phrase string, canonical string")
    want = {(1, "b c d e", "8", 1), (2, "d", None, 1), (None, "c d", "2", 1)}
    for most in (200_000, 0):
        monkeypatch.setattr(rc, "PHRASES", most)
        found = rc.longest_phrase(docs, "k", plain_tokens(F.col("t")), phrases)
        assert {tuple(r) for r in found.collect()} == want
        # looked up, runs are no rows
        assert ("Generate explode" in plan(found)) == (most == 0)


def test_keyword_map_tells_lines_in_the_tasks(spark):
    docs = spark.createDataFrame([(1, "the the\n\nx the\r\n  the2 and\tthe"), (1, "no\nthe"), (2, "ANOTHER"), (3, "żÓŁW\n\n ͏the  żółw the"), (4, None), (None, "x\nthe")], "k long, t string")
    found = di.keyword_map(docs, "k", "t", ["the", "żółw the", "żółw"], around=3)
    rows = {(r.k, r.term): (r.n_lines, r.first, r.excerpt) for r in found.collect()}
    assert rows == {(1, "the"): (4, 0, "the the"), (3, "the"): (1, 2, " ͏the  żó"), (3, "żółw"): (2, 0, "żÓŁW"), (3, "żółw the"): (2, 0, "żÓŁW"), (None, "the"): (1, 1, "the")}
    # a row a text and term comes to the shuffle, no longer one a place
    assert len(re.findall("Exchange hashpartitioning", plan(found))) == 1


def test_folded_texts_of_many_lines_keep_their_places():
    for text in ("a\nb", "A\n\n b  c\t", "  x", "Ł\r\nó", "ÉX\ńy  z", "  q", "İ\n\nb", ""):
        signs, places = [], []
        for at, sign in enumerate(text):
            for c in sign.lower().translate(di._PLAIN):
                c = " " if c.isspace() else c
                if c != " " or not signs or signs[-1] != " ":
                    signs.append(c)
                    places.append(at)
        low, found = di.folded(text)
        assert (low, found or list(range(len(text)))) == ("".join(signs), places)
    assert di.folded("one\ntwo")[1] is None


def test_source_agreement_seeks_blocks_once(spark):
    rng = random.Random(4)
    texts = {k: [f"w{rng.randrange(12)}x" for _ in range(rng.randrange(1, 25))] for k in range(30)}
    blocks = spark.createDataFrame([(k, i % 9, w, rng.choice([0.0, 0.5, 1.0, 2.5])) for k, ws in texts.items() for i, w in enumerate(ws)] + [(99, 0, "ab", 1.0), (98, 1, "lost", None), (None, 0, "w1x", 1.0)], "k long, b int, c string, w double")
    rows = [(k, " ".join(rng.sample(ws, len(ws)) + ["end"])) for k, ws in texts.items()]
    others = spark.createDataFrame(rows + rows[:3], "k long, t string")  # three texts stand twice
    found = bl.source_agreement(blocks, others, "k", "b", "c", "t", F.col("w"))
    assert plan(found).count("MapInArrow") == 1
    told = [(r.k, b.block, b.place, b.w) for r in bl._placed(blocks, others, "k", "b", "c", "t", F.col("w")).collect() for b in r.blocks if r.k is not None]
    placed = spark.createDataFrame([(k, b, p, max(w, 0.1)) for k, b, p, w in told if p is not None], "k long, b int, place long, w double")
    known = {r.k: r.discordance for r in ts.order_discordance(placed, ["k"], "b", "place", "w").collect()}
    got = {r.k: r for r in found.collect()}
    assert got.keys() == {*texts, 98} and (got[98].n_located, got[98].coverage, got[98].discordance) == (0, None, None)
    for k, r in got.items():
        mine = [x for x in told if x[0] == k]
        assert (r.n_blocks, r.n_located) == (len(mine), sum(x[2] is not None for x in mine))
        assert r.discordance == (pytest.approx(known[k]) if k in known else None)


def test_numbers_are_read_once_with_their_surroundings(spark):
    rng = random.Random(5)
    signs = ["2019", "12", "1,5", "7", "od", "saved", "users", "mln", "zł", "%", "lat", "windows", "kraj", "_od", "łod", "x" * 29, "x" * 31, " ", "\n", "\r\n", "-", "99 zł", "v."]
    lines = [*("".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randrange(20))) for _ in range(600)), None, "", "no number\nsaved"]
    docs = spark.createDataFrame(list(enumerate(lines)), "k long, t string")
    found = ts.numbers_in_context(docs, "k", "t")
    # a number's surroundings are brought to one form once, not once a rule
    assert found._jdf.queryExecution().optimizedPlan().toString().count(r"\s+, ") == 1
    windows = [(k, w) for k, t in enumerate(lines) for w in re.findall(r"[^0-9\n]{0,30}[0-9][0-9.,:]*[^0-9\n]{0,30}", t or "")]
    assert sum(r.n for r in found.collect()) == len(windows) > 500
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    want = {}
    for k, w in windows:
        low, number = re.sub(r"[ \t\n\x0b\f\r]+", " ", w).strip(" ").lower(), re.search("[0-9][0-9.,:]*", w)[0]
        said = lambda words, end=edge, low=low: re.search(f"{edge}(?:{words}){end}", low) is not None
        year, impact, money, counted = re.fullmatch("(?:19|20)[0-9]{2}", number.replace(",", ".")) is not None, said(ts.ACHIEVED, ""), said(ts.PAID), said(ts.COUNTED, "")
        rules = [
            (year and (said(ts.DATED) or re.search(r"[-–—/]\s*(?:19|20)[0-9]{2}", low)), "DATE_OR_YEAR"), (said(ts.LASTING) and not impact, "DURATION"), (said(ts.VERSIONED) and not impact, "VERSION_OR_MODEL"),
            (impact and (money or re.search("%|procent", low) or counted), "IMPACT_METRIC"), (counted, "SCALE_METRIC"), (money and said(r"(?:99|24|7)\s*(?:zł|zl)") and not impact, "PRICE_OR_NAME_FRAGMENT"), (money, "SCALE_METRIC"), (year, "DATE_OR_YEAR"), (True, "UNKNOWN_NUMBER"),
        ]
        context = next(name for holds, name in rules if holds)
        want[k, context] = want.get((k, context), 0) + 1
    assert {(r.k, r.context): r.n for r in found.collect()} == want and len({c for _, c in want}) == 7
