"""Defined cases that the tables of the queries don't hold: nulls, ties, empty tables."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import numbers as nm
from tallyroom.functions import text as tx
from tallyroom.operators import calibration, events, graph, intervals, learning, matching, ranking, scoring, texts, views
from tallyroom.sources import html, markup, tables


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_rounding_goes_up(spark):
    assert one(spark, nm.round_half_up(F.col("x")), [(-2.5,), (2.5,), (None,)], "x double") == [-2.0, 3.0, None]


def test_clamp_keeps_null(spark):
    assert one(spark, nm.clamp(F.col("x")), [(None,), (-1.0,), (3.0,), (0.5,)], "x double") == [None, 0.0, 1.0, 0.5]


def test_curve_is_monotone(spark):
    xs = [i / 200 for i in range(201)]
    ys = one(spark, nm.piecewise(F.col("x")), [(x,) for x in xs], "x double")
    assert ys == sorted(ys) and ys[0] == 0 and ys[-1] == 1


def test_jaro_winkler(spark):
    pairs = [("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx"), ("a", "a"), ("", "x"), (None, "x"), ("ab", "cd")]
    assert one(spark, tx.jaro_winkler("a", "b"), pairs, "a string, b string") == [pytest.approx(0.961111, abs=1e-5), pytest.approx(0.84), pytest.approx(0.813333, abs=1e-5), 1.0, 0.0, None, 0.0]


def test_trigrams(spark):
    assert one(spark, tx.trigram_similarity(F.col("a"), F.col("b")), [("night", "nacht"), ("abc", "abc"), ("ab", "ab")], "a string, b string") == [pytest.approx(2 / 10), 1.0, 1.0]


def test_fold_and_phonetic(spark):
    assert one(spark, tx.fold(F.col("x")), [("Łódź ÉÀ",), (None,)], "x string") == ["lodz ea", None]
    assert one(spark, tx.phonetic(F.col("x")), [("Rzeka",), ("Chleb",)], "x string") == ["zeka", "hleb"]


def test_scrub_order(spark):
    text = "see https://a.b/7?x=me@x.pl and 550e8400-e29b-41d4-a716-446655440000, mail me@x.pl 123\n  45"
    assert one(spark, tx.scrub(F.col("x")), [(text,), (None,), ("",)], "x string") == ["see [url] and [uuid], mail [email] # #", None, ""]


def test_fingerprint(spark):
    got = one(spark, tx.fingerprint("x"), [("Error  12 at line 7",), ("error 99 AT line 8",), ("other",), (None,)], "x string")
    assert got[0] == got[1] != got[2] and got[3] is None
    assert tx.fnv1a("") == 0x811C9DC5


def test_power_mean_leaves_out_nulls(spark):
    rows = [(1, 4.0, 1.0), (1, None, 5.0), (1, 9.0, 0.0), (2, None, 1.0)]
    out = {r["k"]: r["mean_1"] for r in scoring.power_means(spark.createDataFrame(rows, "k int, v double, w double"), ["k"], "v", "w").collect()}
    assert out[1] == pytest.approx(4.0) and out[2] is None


def test_renormalised(spark):
    got = one(spark, scoring.renormalised({"a": 0.5, "b": 0.25}), [(80.0, None), (None, None), (0.0, 90.0)], "a double, b double")
    assert got == [80.0, None, pytest.approx(30.0)]


def test_double_budget_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.choice("xyz"), rng.choice([None, -1.0, 2.0, 3.5, 6.0])) for g in range(5) for i in range(12)]
    got = {(r.g, r.o): r.applied for r in scoring.double_budget(spark.createDataFrame(rows, "g int, o int, d string, r double"), ["g"], "o", "d", "r", 12.0, 5.0).collect()}
    for g in range(5):
        used, by = 0.0, {}
        for _, o, d, r in [x for x in rows if x[0] == g]:
            give = min(max(0.0, r or 0.0), max(0.0, 5.0 - by.get(d, 0.0)), max(0.0, 12.0 - used))
            used, by[d] = used + give, by.get(d, 0.0) + give
            assert got[g, o] == pytest.approx(give)


def test_closure_of_a_cycle_ends(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "id int, parent int")
    got = {(r.id, r.ancestor) for r in matching.ancestors(rows).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b}


def test_units_have_three_values(spark):
    rows = [(1, "ANY_OF", 1.0, 0.0, "UNKNOWN"), (1, "ANY_OF", 2.0, 0.0, "NOT_FOUND"), (2, "ALL_OF", 1.0, 1.0, "CONFIRMED"), (2, "ALL_OF", 1.0, 0.0, "UNKNOWN"), (3, "ALL_OF", 1.0, 1.0, "CONFIRMED")]
    got = {r.k: (r.status, r.weight) for r in matching.logical_units(spark.createDataFrame(rows, "k int, op string, weight double, fulfilment double, status string"), ["k"], "op").collect()}
    assert got == {1: ("UNKNOWN", 2.0), 2: ("UNKNOWN", 2.0), 3: ("CONFIRMED", 1.0)}


def test_union_with_and_without_compaction(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), s, s + rng.randint(-2, 9)) for s in [rng.randint(0, 200) for _ in range(300)]]
    df = spark.createDataFrame(rows, "k int, s long, e long")
    for adjacent, inclusive in ((0, False), (1, True)):
        plain = {r.k: (r.length, r.n_islands) for r in intervals.union_length(df, ["k"], "s", "e", adjacent=adjacent, inclusive=inclusive).collect()}
        small = {r.k: (r.length, r.n_islands) for r in intervals.union_length(intervals.compact(df.where("s <= e"), ["k"], "s", "e", 16), ["k"], "s", "e", adjacent=adjacent, inclusive=inclusive).collect()}
        assert plain == small
        if inclusive:
            assert plain == {k: (len({p for q, s, e in rows if q == k for p in range(s, e + 1)}), plain[k][1]) for k in plain}


def test_gap_limits(spark):
    rows = [(1, 0, 3, 10), (1, 9, 9, 11), (1, 17, 18, 12), (1, 18, 30, 13)]
    got = [(r.after, r.before, r.gap) for r in intervals.gaps(spark.createDataFrame(rows, "k int, s int, e int, h int"), ["k"], "s", "e", "h", 6).collect()]
    assert got == [(11, 12, 7)]


def test_first_wins_and_empty_keys(spark):
    left, right = spark.createDataFrame([("a", 1), ("a", 2)], "n string, o int"), spark.createDataFrame([("A", 0), ("", 3), ("b", 4)], "n string, o int")
    assert {(r.n, r.o) for r in ranking.first_wins(left, right, F.lower("n"), "o").collect()} == {("a", 1), ("b", 4)}


def test_null_groups_pass_the_group_limit(spark):
    rows = spark.createDataFrame([(None, i) for i in range(5)] + [(1, i) for i in range(5, 10)], "g int, o int")
    assert [r.o for r in ranking.capped_selection(rows, "g", [F.asc("o")], 2, 10).orderBy("rank").collect()] == [0, 1, 2, 3, 4, 5, 6]


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, 4.0), (1, 2, 9.0), (1, 3, 1.0)], "g int, o int, c double")
    assert [r.o for r in ranking.within_budget(rows, ["g"], [F.col("o")], "c", 6.0).collect()] == [1]


def test_window_end_is_inside(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 5, 10, 11, 12)] + [(None, 3)], "k string, t long")
    got = {(r.k, r.t): r.ok for r in events.ordered_fold(rows, "k", ["t"], "t", events.fixed_window_rule(10, 2), "ok").collect()}
    assert got == {("a", 0): True, ("a", 5): True, ("a", 10): False, ("a", 11): True, ("a", 12): True, (None, 3): True}


def test_throttle_counts_from_the_last_accepted(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 6, 10, 15, 20)], "k string, t long")
    got = {r.t: r.ok for r in events.ordered_fold(rows, "k", ["t"], "t", events.throttle_rule(10), "ok").collect()}
    assert got == {0: True, 6: False, 10: True, 15: False, 20: True}


@pytest.mark.parametrize("n,kept", [(4, False), (5, True)])
def test_k_anonymity(spark, n, kept):
    rows = spark.createDataFrame([("x", u) for u in range(n)] + [("x", 0)] * 9 + [("x", None)], "t string, u int")
    assert bool(events.k_anonymous(rows, F.col("t"), "u").collect()) == kept


def test_parallel_edges_and_dead_ends(spark):
    v = spark.createDataFrame([(i,) for i in range(4)], "id int")
    e = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 0)], "src int, dst int")
    got = {r.id: r.rank for r in graph.pagerank(v, e, rounds=20).collect()}
    rank = [0.25] * 4
    for _ in range(20):
        lost = rank[2] + rank[3]
        into = [rank[1], rank[0] * 2 / 3, rank[0] / 3, 0]
        rank = [0.15 / 4 + 0.85 * (x + lost / 4) for x in into]
    assert sum(got.values()) == pytest.approx(1) and [got[i] for i in range(4)] == pytest.approx(rank)


def test_bounded_paths_take_the_cheap_way_round(spark):
    costs = spark.createDataFrame([(1, 2, 9.0, 1.0), (1, 3, 1.0, 1.0), (3, 2, 1.0, 1.0), (2, 4, 1.0, 1.0)], "src int, dst int, cost double, sure double")
    got = {r.node: (r.cost, r.hops, r.path) for r in graph.bounded_paths(spark.createDataFrame([(1,)], "source int"), costs, 2).collect()}
    assert got == {2: (2.0, 2, [1, 3, 2]), 3: (1.0, 1, [1, 3]), 4: (10.0, 2, [1, 2, 4])}


def test_agreement_counts_shared_only(spark):
    a, b = spark.createDataFrame([(1, "x")] * 3 + [(1, "y")], "k int, t string"), spark.createDataFrame([(1, "x")] * 2 + [(2, "z")], "k int, t string")
    got = {r.k: (r.n_left, r.n_right, r.n_shared) for r in texts.token_agreement(a, b, ["k"], "t").collect()}
    assert got == {1: (4, 2, 2), 2: (0, 1, 0)}


def test_damage(spark):
    got = texts.encoding_damage(spark.createDataFrame([("ab  �",), (None,)], "t string"), "t").collect()
    assert got[0].damage_mass == pytest.approx(1.9) and got[0].lexical == 2 and got[1].damage == 0 and got[1].encoding == 1


def test_corpus_dedup_keeps_all_labels(spark):
    df = spark.createDataFrame([(2, "a", ["x"], 1.0), (1, "a", ["y"], 0.5), (3, "b", ["x"], None)], "id int, t string, l array<string>, w double")
    got = {r.id: (r.l, r.w) for r in learning.dedup_corpus(df, F.col("t"), "id", "l", "w").collect()}
    assert got == {1: (["x", "y"], 1.0), 3: (["x"], None)}


def test_gate_breaks_on_null(spark):
    df = spark.createDataFrame([(0.1, None)], "a double, b double")
    assert [r.metric for r in calibration.gate(df, {"a": ("max", 0.2), "b": ("min", 0.5)}).collect()] == ["b"]


def test_posting_passes_over_broken_blocks(spark):
    long = "work " * 30
    page = f'<html><title>Role | Site</title><script type="application/ld+json">{{broken</script><script type="application/ld+json">{{"@type":"JobPosting","title":"Baker","description":"<p>{long}</p>"}}</script><p>{long}{long}</p></html>'
    shell = '<html><head><meta property="og:description" content="short"></head><body><div id="root"></div><script>x()</script></body></html>'
    df = spark.createDataFrame([(1, "https://www.A.pl:80/x", page), (2, None, None), (3, "x", shell)], "page_id int, url string, html string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert (got[1].tier, got[1].title, got[1].domain, got[1].description) == ("json-ld", "Baker", "a.pl", long.strip())
    assert got[2].tier == "none" and got[2].title is None and (got[3].tier, got[3].description) == ("open-graph", "short")
    assert one(spark, html.is_shell(F.col("h")), [(shell,), (page,)], "h string") == [True, False]


LONG = "word " * 20


@pytest.mark.parametrize(
    ("page", "main"),
    [
        (f'<body><main><div role="navigation"><div>menu</div>MENU TAIL</div><p>{LONG}</p></main></body>', LONG.strip()),
        (f'<body>before<div role="main"><div>one</div><div>two {LONG}</div></div>after</body>', f"one two {LONG.strip()}"),
        (f"<body><main>short</main><article>a<article>b</article>{LONG}</article></body>", f"a b {LONG.strip()}"),
        (f"<main><nav><p>a<nav>b</nav>c</nav><p>un<b>closed<p>{LONG}</main></div>", f"un closed {LONG.strip()}"),
        (f"<header><main>{LONG}</main></header><main>{LONG}&amp;</main>", f"{LONG}&"),
        (f"<main a='>' b=\"<p>\">{LONG}<!-- <p>no</p> --><script>'</main>'</script><br/>x</main>", f"{LONG}x"),
        (f"<aside>{LONG}</aside><main>little</main>", None), ("", None), (None, None),
    ],
)
def test_main_content_by_structure(page, main):
    assert markup.Page(page or "").main(80, 20_000) == main


def test_pages_are_read_in_linear_time():
    began = time.process_time()
    for piece in ("<div>", "<b><p>", "</x>", "<", "<a ", '<a b="', "<!--", "<li>", "<script>", "<main><nav>", '<p class="company">'):
        page = markup.Page(piece * 30_000)
        page.main(80, 20_000), page.employer()
    assert time.process_time() - began < 30


def test_robots_groups(spark):
    files = [
        ("a", "User-agent: *\nDisallow: /\nUser-agent: tally\nDisallow:\n"),  # a name without rules is as if it were not there
        ("b", "User-agent: bot\nDisallow: /x\n\nUser-agent: tal\nDisallow: /y"),  # names of one length: the first
        ("c", "User-agent: tally\nDisallow: /x # no\nUser-agent: *\nDisallow: /\nUser-agent: TALLY\nUser-agent: z\nAllow: /x/ok"),  # one name in two places
        ("d", "Disallow: /\nnonsense\n: /"), ("e", None),
    ]
    rules = html.robots_rules(spark.createDataFrame(files, "host string, text string"), "TallyBot/1")
    urls = [(h + p, h, p) for h in "abcde" for p in ("/1", "/x", "/x/ok", "/y")]
    got = {r.url: r.allowed for r in html.robots(rules, spark.createDataFrame(urls, "url string, host string, path string")).collect()}
    assert [u for u in sorted(got) if not got[u]] == ["a/1", "a/x", "a/x/ok", "a/y", "b/x", "b/x/ok", "c/x"]


def test_robots_longest_wins_and_allow_on_ties(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/c", False), ("h", "/c", True)], "host string, pattern string, allow boolean")
    urls = spark.createDataFrame([("u1", "h", "/a/x"), ("u2", "h", "/a/b/c"), ("u3", "h", "/c"), ("u4", "g", "/a")], "url string, host string, path string")
    assert {r.url: r.allowed for r in html.robots(rules, urls).collect()} == {"u1": False, "u2": True, "u3": True, "u4": True}


def test_records_with_bad_lines(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2, "z": 3}\n')
    good, bad = tables.read_records(spark, f"file://{tmp_path}/x.jsonl", schema)
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r[0] for r in bad.collect()] == ["{broken"]
    (tmp_path / "x.csv").write_text('a,b\n1,"x, ""y"""\nno,z\n2,"two\nlines"\n1,a\n')
    good, bad = tables.read_records(spark, f"file://{tmp_path}/x.csv", schema, "csv", line_breaks=True)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "a"), (1, 'x, "y"'), (2, "two\nlines")] and [r[0] for r in bad.collect()] == ["no,z"]


def test_lexicon_rank(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("domy\tdom\tsubst:pl\ndomy\tdoma\tadj\nbez pola\nbad one\tx\tsubst\nźle\tzły\tadv\n")
    got = {r.form: (r.lemma, r.folded) for r in tables.read_lexicon(spark, f"file://{tmp_path}/l.tsv", ["subst", "adj", "adv"]).collect()}
    assert got == {"domy": ("dom", "domy"), "źle": ("zły", "zle")}


def test_validate(spark):
    good, bad = tables.validate(spark.createDataFrame([(1,), (None,), (-1,)], "x int"), {"positive": "x > 0", "small": "x < 9"})
    assert [r.x for r in good.collect()] == [1] and sorted(map(len, (r.broken_rules for r in bad.collect()))) == [1, 2]


def test_tiered_search_compares_every_pair(spark):
    from tallyroom.functions.text import edit_similarity
    from tallyroom.operators import graph

    names = spark.createDataFrame([(1, "new widget", 0.8, [], []), (2, "large gizmo", 0.8, None, []), (3, "plain", 0.8, ["red widgte"], []), (4, "red wigdet", 0.8, [], []), (5, "far off", 0.8, [], [])], "id int, name string, confidence double, aliases array<string>, tags array<string>")
    queries = spark.createDataFrame([("red wigdet",), ("larg gear",), ("plian",)], "query string")
    got = {(r["query"], r.id): (round(r.score, 6), r.tier) for r in graph.tiered_search(queries, names, edit_similarity).collect()}
    assert got == {("red wigdet", 1): (0.65, "fuzzy"), ("red wigdet", 3): (0.725, "fuzzy"), ("red wigdet", 4): (1.0, "exact"), ("larg gear", 2): (0.609091, "fuzzy"), ("plian", 3): (0.65, "fuzzy")}


def test_structure_of_what_there_is(spark):
    """Parts that lack are no basis, an unsure order is left out, and nothing at all is null."""
    rows = spark.createDataFrame([(1, 0.5, None, None), (2, None, 0.9, 0.5), (3, 0.5, 0.9, 0.5), (4, None, None, None)], "k int, damage double, order_confidence double, d double")
    rows = rows.withColumns({"comparable_w": F.when(F.col("d").isNotNull(), 1.0), "discordant_w": F.col("d")})
    got = {r.k: (r.encoding, r.reading_order, r.structure) for r in scoring.structure_score(rows).collect()}
    assert got[1][1] is None and got[1][2] == pytest.approx(0, abs=1e-9) and got[4] == (None, None, None)
    assert got[2][1] == pytest.approx(2 ** (-0.5 / 0.12)) and got[2][2] == pytest.approx(100 * 2 ** (-0.5 / 0.12))
    unsure = {r.k: (r.reading_order, r.structure_cap) for r in scoring.structure_score(rows, least_order=0.95).collect()}
    assert unsure[2] == (None, None) and unsure[3][1] == 45.0
    assert "list_glyphs" not in scoring.structure_score(rows).columns


def test_paths_of_sure_edges(spark):
    edges = spark.createDataFrame([(1, 2, "a", 0.9, 1.0), (2, 3, "a", 0.9, 0.5), (1, 3, "b", 0.2, 1.0), (3, 4, "c", None, 1.0), (2, 5, "c", 0.8, 1.0)], "src int, dst int, type string, confidence double, weight double")
    source = spark.createDataFrame([(1,)], "source int")
    ways = lambda **k: {r.node: (r.path, round(r.sure, 6)) for r in graph.bounded_paths(source, graph.path_costs(edges, **{x: y for x, y in k.items() if x != "exclude"}), 4, k.get("exclude")).collect()}
    assert ways(least=0.3) == {2: ([1, 2], 0.9), 3: ([1, 2, 3], 0.405), 5: ([1, 2, 5], 0.72)}
    assert set(ways(least=0.3, types=["c"])) == set() and set(ways(types=["a", "b"])) == {2, 3}
    assert set(ways(least=0.1, exclude=spark.createDataFrame([(2,)], "x int"))) == {3}


def test_views(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    assert views.owned_rows(one([(1, "a"), (2, None)], "k int, o string"), "o", F.lit(None).cast("string")).count() == 0
    found = views.findable(one([(1, 0.9, None, "x"), (2, None, None, "x"), (3, 0.9, "rejected", "x"), (4, 0.9, "ok", "y")], "id int, confidence double, status string, type string"), least=0.5, kinds=["x"])
    assert [r.id for r in found.collect()] == [1]
    people, none = one([(1, 3), (2, 1)], "k int, quota int"), one([], "k int, status string")
    uses = one([(1,), (1,), (2,), (2,), (9,)], "k int")
    assert sorted(map(tuple, views.entitlements(people, "k", "quota", none, uses, uses).collect())) == [(1, "none", 2, 2, 1), (2, "none", 2, 2, 0)]
    claims = one([(1, ["a", "a", None]), (2, ["a"]), (None, ["a"]), (1, ["b"]), (2, ["b"]), (3, None)], "id int, tags array<string>")
    tags = {r.tag: (r.n_claims, r["mark"]) for r in views.tag_claims(claims, "id", "tags").collect()}
    assert tags["a"] == tags["b"] and tags["a"][0] == 2
    labels = one([("s", f"L{i % 70:02}", None) for i in range(140)] + [("s", "hidden", True), ("s", None, None)], "skill string, label string, derived boolean")
    (row,) = views.skill_labels(labels, "skill", "label", F.col("derived"), 3).collect()
    assert (row.n, row.labels) == (70, ["l00", "l01", "l02"])
    changes = one([(1, 5.0), (1, 7.0), (3, 9.0), (None, 1.0), (2, 8.0)], "id int, v double")
    got = sorted(map(tuple, views.proposals(one([(1, 1.0), (2, 100.0), (4, 2.0)], "id int, v double"), changes, "id", "v", F.col("v") > 50).collect()))
    assert got == [(1, "UPDATED", 7.0), (2, "PENDING", 100.0), (3, "NEW", 9.0), (4, "SAME", 2.0)]
    assert views.distinct_names(one([("A",), ("a",), (None,)], "n string"), F.col("n")).first().n_names == 1
    assert one_value(spark, views.json_element(F.col("j"), "a.b", "long"), [('{"a": {"b": 7}}',), ('{"a": "x"}',), ("{", ), (None,), ('{"a": {"b": "x"}}',)]) == [7, None, None, None, None]


def one_value(spark, column, rows):
    return [r[0] for r in spark.createDataFrame(rows, "j string").select(column).collect()]
