"""Text operators on small odd texts: dictionaries, chunks, claims, columns, blocks, orders, profiles."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import features as ft
from tallyroom.functions import phrases as ph
from tallyroom.operators import blocks as bl
from tallyroom.operators import claims as cl
from tallyroom.operators import dictionary as di
from tallyroom.operators import learning as ln
from tallyroom.operators import profiles as pr
from tallyroom.operators import requirements as rq
from tallyroom.operators import resume
from tallyroom.operators import texts as ts


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "k long, t string")


def test_places_of_phrases(spark):
    odd = ["Żółw  c++ c+++ C++11 x", "node.js\nNode.js, NODE\t JS", "e\u0301cole ÉCOLE ecoles", None, "", "o-the-r the", "a a a"]
    rows = di.phrase_rows(texts(spark, *odd), "k", "t", ["zolw c++", "c++", "node.js", "node js", "école", "the", "a a", "a"]).collect()
    got = sorted((r.k, r.start, r.end, odd[r.k][r.start : r.end]) for r in rows)
    assert got == [
        (0, 0, 9, "Żółw  c++"), (0, 6, 9, "c++"), (0, 15, 18, "C++"), (1, 0, 7, "node.js"), (1, 8, 15, "Node.js"), (1, 17, 25, "NODE\t JS"), (2, 0, 6, "e\u0301cole"[:6]), (2, 7, 12, "ÉCOLE"),
        (5, 2, 5, "the"), (5, 8, 11, "the"), (6, 0, 1, "a"), (6, 0, 3, "a a"), (6, 2, 3, "a"), (6, 2, 5, "a a"), (6, 4, 5, "a"),
    ]
    assert {r.line for r in rows if r.k == 1 and r.start > 7} == {1}


def test_dictionary_in_blocks_is_the_whole(spark, monkeypatch):
    words = ["w" + chr(97 + i // 20) + chr(97 + i % 20) for i in range(40)]
    table = spark.createDataFrame([(w.upper() if i % 2 else w,) for i, w in enumerate(words)] + [(None,), ("",)], "p string")
    docs = texts(spark, " ".join(words), f"{words[1]} {words[1]} {words[39]}")
    whole = sorted(map(tuple, di.phrase_rows(docs, "k", "t", table).collect()))
    monkeypatch.setattr(di, "PHRASES", 7)
    assert sorted(map(tuple, di.phrase_rows(docs, "k", "t", table).collect())) == whole and len(whole) == 43


def test_phrases_against_patterns(spark):
    rng = random.Random(4)
    some = ["a", "ab", "a b", "b+", "#a", "a1"]
    lines = ["".join(rng.choice("ab +#1_.\n") for _ in range(25)) for _ in range(300)]
    got = sorted((r.k, r.phrase, r.start) for r in di.phrase_rows(texts(spark, *lines), "k", "t", some).collect())
    want = []
    for k, line in enumerate(lines):
        for p in some:
            form = r"\s+".join(map(re.escape, p.split()))
            want += [(k, p, m.start()) for m in re.finditer(rf"(?<![\w#+])(?={form}(?:[0-9]+(?:\.[0-9]+)*)?(?![\w#+]))", line)]
    assert got == sorted(want)


def test_keyword_excerpt_is_of_the_place(spark):
    (row,) = di.keyword_map(texts(spark, "x\no-the-r ..................... other the end\nthe"), "k", "t", ["other the"]).collect()
    assert (row.n_lines, row.first, row.excerpt) == (1, 1, "................... other the end"[-33:])


def test_without_phrases(spark):
    rows = di.without_phrases(texts(spark, "I am  a team player, a team!", "none  here", None, "a team a team"), "k", "t", ["a team", "team player"]).collect()
    assert [(r.t, r.removed) for r in sorted(rows)] == [("I am player, !", ["a team"]), ("none  here", []), (None, []), ("", ["a team"])]


def test_slots(spark):
    got = [r.s for r in texts(spark, "Built a lake, Spark, 40 %", "Ran", " ", None).select(di.slots(F.col("t")).alias("s"), "k").orderBy("k").collect()]
    assert [tuple(g)[:4] for g in got] == [("Built", "a lake, Spark, 40 %", "Spark", "40 %"), ("Ran", "Ran", "", ""), (None,) * 4, (None,) * 4]
    assert got[0].keywords == ["Built", "lake,", "Spark,"]


def test_guarded_definitions(spark):
    rows = spark.createDataFrame([("go", "Go", "backend"), ("lang", "golang", None), ("lang", "go lang", None)], "name string, alias string, guard string")
    got = di.taxonomy_tags(texts(spark, "go go home", "backend in GO", "golang go lang", None), "k", "t", rows)
    assert sorted(map(tuple, got.collect())) == [(1, "go", 1), (2, "lang", 2)]


def test_chunks(spark):
    text = "We use SAP ERP. The Team builds Blue Ocean with Node.js; Blue Ocean grows. Need Kafka. The SQL (Server) Łódź łódź 2020 Python Django"
    rows = cl.dynamic_phrases(texts(spark, text, "Blue Ocean SAP", None, ""), "k", "t", ["we", "the", "need", "team"], ["python"])
    got = {(r.k, r.phrase): (r.times, r.technical) for r in rows.collect()}
    assert got == {(0, "sap erp"): (1, True), (0, "blue ocean"): (2, False), (0, "node.js"): (1, True), (0, "sql"): (1, True), (0, "lodz"): (2, False), (1, "blue ocean sap"): (1, True)}


def test_verdicts(spark):
    claims = texts(spark, "Zbudowalem k8s i c# w 40 %", "plain sql 12 000 osob", "go", None)
    sources = spark.createDataFrame([(0, "Kubernetes, 40 procent"), (0, "C#"), (1, "SQL plain 12000 osob"), (9, "go")], "k long, t string")
    synonyms = spark.createDataFrame([("k8s", "kube"), ("kube", "kubernetes"), ("kubernetes", "k8s")], "label string, canonical string")
    got = {r.k: (r.unknown, r.invented, r.verdict) for r in cl.truth_verdicts(claims, sources, "k", "t", synonyms, ["i", "w", "procent", "osob"]).collect()}
    assert got[0] == ([], [], "PASS") and got[2] == (["go"], [], "FAIL") and got[3] == ([], [], "PASS")
    assert got[1][1] == [] and got[1][0] == ["000", "12"]


@pytest.mark.parametrize(
    ("text", "frames"),
    [
        ("TypeError: boom\n  at Object.run [as go] (file:///a/b.js:3:4)\n at async fn (native)\n at C:\\x\\y.js:7:1", [("Object.run [as go]", "b.js", 3), ("async fn (native)", None, None), (None, "y.js", 7)]),
        ("f@http://x.y/z.js:1:2\n@\n@w.js:4:1\na@b@c.js:1:2\nat", [("f", "z.js", 1), (None, "w.js", 4), ("a", "b@c.js", 1), ("at", None, None)]),
        ("plain (x)\nError: no\nName\nat  Spaced", [("Name", None, None), ("Spaced", None, None)]), (None, []),
    ],
)
def test_stack_frames(spark, text, frames):
    (row,) = texts(spark, text).select(ph.stack_frames(F.col("t")).alias("f")).collect()
    assert [tuple(f) for f in row.f] == frames


def test_metrics(spark):
    text = "v2 grew by -7,50 mln, +3 dni and 1 000 000 osob; 12 34, 5k, 6kg, x9 − 8 %"
    (row,) = texts(spark, text).select(ph.said_metrics(F.col("t")).alias("m")).collect()
    assert row.m == ["-7.50mln", "3dni", "1000000osob", "12", "34", "5k", "6", "-8%"]


def test_columns(spark):
    two = "Jan | Skills\nWelder | mig\nbaker\nx | a | b\n\n| right\nleft |"
    fields = "Welder | Acme ltd\nDriver | Bolt ltd\nmore\nand more"
    rows = texts(spark, two, fields, "a | b\nc | d", None, "", fields.replace("ltd", "x"))
    got = [r[0] for r in rows.select(bl.unwrapped_columns(F.col("t"), ["welder", "driver"], ["ltd"]).alias("u"), "k").orderBy("k").collect()]
    assert got == ["Jan\nWelder\nbaker\nx\nleft\n\nSkills\nmig\na | b\nright", fields, "a | b\nc | d", None, "", "Welder\nDriver\nmore\nand more\n\nAcme x\nBolt x"]


def test_blocks(spark):
    rows = bl.text_blocks(texts(spark, " top\r\n\r\nSkills\nmig\n tig\nSkills\nJobs\nwelder", "Jobs", None, "\u0001x\u0002"), "k", "t", {"S": "skills", "J": "jobs"}).collect()
    assert sorted(map(tuple, rows)) == [(0, 0, "HEADER", "top"), (0, 1, "S", "mig\ntig"), (0, 2, "J", "welder"), (3, 0, "HEADER", "x")]


def brute_discordance(rows):
    """{owner: (comparable, discordant)} of (owner, f, s, w)."""
    out = {}
    for (a, f, s, w), (b, f2, s2, w2) in itertools.combinations(rows, 2):
        if a == b and None not in (f, s, f2, s2) and f != f2 and s != s2 and min(w, w2) > 0:
            both = out.setdefault(a, [0.0, 0.0])
            both[0] += min(w, w2)
            both[1] += min(w, w2) * ((f < f2) != (s < s2))
    return out


def test_weighted_orders_against_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, *range(9)]), rng.choice([None, *range(20)]), rng.choice([0.0, 0.1, 0.5, 1.0, 2.5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "o string, f int, s int, w double")
    for weight, known in (("w", rows), (None, [(*r[:3], 1.0) for r in rows])):
        got = {r.o: (r.comparable, r.discordant) for r in ts.order_discordance(df, ["o"], "f", "s", weight).collect()}
        assert {o: pytest.approx(v) for o, v in got.items()} == {o: tuple(v) for o, v in brute_discordance(known).items()}


def test_source_agreement(spark):
    blocks = spark.createDataFrame([(1, i, c) for i, c in enumerate(["Alpha  beta", "gamma", "de", "delta x", "lost one", "gamma"])] + [(2, 0, "abc")], "k long, b int, c string")
    other = spark.createDataFrame([(1, "GAMMA and delta\nX then alpha beta")], "k long, t string")
    placed = {(r.k, r.b): r.place for r in bl.located_blocks(blocks, other, "k", "b", "c", "t").collect()}
    assert placed == {(1, 0): 23, (1, 1): 0, (1, 3): 10, (1, 4): None, (1, 5): 0, (2, 0): None}
    got = {r.k: (r.n_blocks, r.n_located, r.coverage, r.in_order, r.discordance) for r in bl.source_agreement(blocks, other, "k", "b", "c", "t", F.lit(2.0)).collect()}
    assert got == {1: (5, 4, 0.8, 2, 0.8), 2: (1, 0, 0.0, 0, None)}


def test_rule_profiles(spark):
    rules = [("p", "a", "a", "required"), ("p", "b", "b", "advised"), ("q", "a", "a", "forbidden")]
    got = {(r.k, r.profile): (r.found, r.missing, r.advice, r.passed) for r in pr.rule_profiles(texts(spark, "a", None), "k", "t", rules).collect()}
    assert got == {(0, "p"): (["a"], [], ["b"], True), (0, "q"): (["a"], ["a"], [], False), (1, "p"): ([], ["a"], ["b"], False), (1, "q"): ([], [], [], True)}


CV = """Anna Nowak
Doświadczenie zawodowe
05.2019 – obecnie
Firma Stal, Spawacz
• spawanie MIG
  i TIG
Kierowca w Bank Polski
2010 - 2012
Wożenie.
Klauzula
Wyrażam zgodę
dalej zgoda
Edukacja
Politechnika Łódzka
Inżynier, 2001-2005
Liceum nr 1 1997 to 2001
Kursy:
UDT - TDT 2018
Języki obce: angielski B2; niemiecki
Projekty
1. Most (stal, beton): długi
- mocny
"""


def test_profile_sections(spark):
    got = resume.parsed_profiles(texts(spark, CV, None, ""), "k", "t").orderBy("k").collect()
    row = got[0]
    assert [tuple(e) for e in row.experience] == [("Spawacz", "Firma Stal", 2019 * 12 + 4, None, True, None, ["spawanie MIG i TIG"]), ("Kierowca", "Bank Polski", 2010 * 12, 2012 * 12, False, "Wożenie.", [])]
    assert [tuple(e) for e in row.education] == [("Inżynier", "Politechnika Łódzka", 2001 * 12, 2005 * 12), (None, "Liceum nr 1", 1997 * 12, 2001 * 12)]
    assert [tuple(e) for e in row.certificates] == [("UDT", "TDT", 2018)] and [tuple(e) for e in row.languages] == [("angielski", "B2"), ("niemiecki", None)]
    assert row.name == "Anna Nowak" and row.summary is None and "zgod" not in str(row).lower().replace("doświadczenie", "")
    assert row.projects[0].tools == ["stal", "beton"] and row.projects[0].description.endswith("mocny")
    assert got[1].experience == [] and got[2].name is None


def test_mentions_and_requirements(spark):
    offer = "We use SQL.\nRequirements:\nPython, no Java; Go is a plus. Docker\nNice to have\nSQL 3.5 must be known. ŻÓŁW\nDuties\nPython"
    rows = rq.mentions(texts(spark, offer, None, "", "SQL"), "k", "t", ["sql", "python", "java", "go", "docker", "zolw", "requirements"]).collect()
    got = [(offer[r.start : r.end], r.line, r.section, r.polarity, r.confidence) for r in sorted(rows, key=lambda r: r.start) if r.k == 0]
    assert got == [
        ("SQL", 0, None, "INFORMATION", 0.35), ("Python", 2, "REQUIRED", "REQUIRED", 0.65), ("Java", 2, "REQUIRED", "NEGATED", 0.65), ("Go", 2, "REQUIRED", "PREFERRED", 0.65),
        ("Docker", 2, "REQUIRED", "REQUIRED", 0.65), ("SQL", 4, "PREFERRED", "REQUIRED", 0.65), ("ŻÓŁW", 4, "PREFERRED", "PREFERRED", 0.65), ("Python", 6, "DUTIES", "INFORMATION", 0.35),
    ]
    found = rq.mentions(texts(spark, offer), "k", "t", ["sql", "python", "java", "go"])
    names = spark.createDataFrame([("python", "Snake"), ("go", "Snake")], "phrase string, name string")
    assert sorted(map(tuple, rq.extracted_requirements(found, "k", names).collect())) == [(0, "Snake", "REQUIRED", 3, 26, 0.65), (0, "sql", "REQUIRED", 2, offer.index("SQL 3.5"), 0.65)]


def test_features_in_tasks_are_those_of_columns(spark):
    odd = [None, "", "C++ c# c### .NET,node.js k8s_k8s [gone c++] x", "www.a.b --a/b-- 12 a1b 1ab ab1 ²ab1 aⅧ1 ½x1b ł1ó", "a\n\r\nbb\n  \nccc\nlong line", "to be " * 9, "ÀÉ–Ż — ©®|\\_=<>\ufffd x_y", "İstanbul ΣΑΣ \u00a0 x\x0by", "l1t " * 400, "a" * 49 + " " + "b" * 48, "[ open ++ [] a"]
    random.seed(5)
    odd += ["".join(random.choices("ab1_ .+#[]\n²ż-/c", k=random.randrange(400))) for _ in range(60)]
    rows = texts(spark, *odd).select("k", "t", ln.text_features(F.col("t")).alias("f"), ln.meta_features(F.col("t")).alias("m")).collect()
    known = ft.Tokens()
    for r in rows:
        assert sorted(ft.features(r.t, known)) == sorted(r.f), r.t
        assert ft.marks(r.t, ft.tokens(r.t, known)) == r.m, r.t
    assert sorted(map(tuple, ln.form_rows(texts(spark, *odd), "k", "t").collect())) == sorted((r.k, x) for r in rows for x in r.m)
    counted = ln.feature_counts(texts(spark, *odd).withColumn("l", F.col("k") % 2), "t", "l").groupBy("l", "feature").agg(F.sum("n")).collect()
    assert sorted(map(tuple, counted)) == sorted((k, f, sum(f in r.f for r in rows if r.k % 2 == k)) for k in (0, 1) for f in {f for r in rows if r.k % 2 == k for f in r.f})


def test_counts_of_phrases_are_their_places(spark):
    odd = ["Żółw  c++ c+++ C++11 the2 the2.5x the22", "node.js\nNode.js, the_ #the the# the", "e\u0301cole ÉCOLE ecoles", None, "", "o-the-r the THE", "a a a"]
    for phrases in (["zolw c++", "c++", "node.js", "école", "the", "the2", "a a", "a"], ["the", "école", "the2", "zolw"], ["node js", "a a"]):
        rows = di.phrase_rows(texts(spark, *odd), "k", "t", phrases).groupBy("k", "phrase").count().collect()
        counts = di.phrase_counts(texts(spark, *odd), "k", "t", phrases).collect()
        assert sorted((r.k, r.phrase, r.n) for r in counts) == sorted(map(tuple, rows))


def test_words_of_profiles_are_compiled_once():
    reader = resume.Reader(resume.Words())
    for line in ["Welder", "a welder's", "awelder", "ŁÓDŹ Bank", "Engineer's", ""]:
        for words in (reader.words.roles, reader.words.firms, reader.words.degrees, ()):
            assert reader._has(line, words) == any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", di.folded(line)[0]) for w in words)
    before = resume._any_of.cache_info().misses
    assert not reader._has("nobody", reader.words.roles) and resume._any_of.cache_info().misses == before


def test_a_range_reads_its_text_once(spark):
    assert str(ph.month_range(F.upper(F.col("t")))).count("upper(") == 1
    rows = texts(spark, "07.2019 - 09.2020", "2020 / 2018", "Jan 2019 — Mar 2019", "1-2-3", None, "2019-13", "2019")
    got = [r.r and tuple(r.r) for r in rows.orderBy("k").select(ph.month_range(F.col("t")).alias("r")).collect()]
    assert got == [(24234, 24248), None, (24228, 24230), None, None, None, (24228, 24228)]
