"""The numbered queries against SQL and brute force on small tables, and their defined cases."""

from __future__ import annotations

import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import chat_format, decontamination, jaccard_join, line_dedup, mixing, quality_classifier, quality_rules, queries, token_counts, toxicity, url_filters
from tallyroom.llm.common import bounded_labels
from tallyroom.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^ \t-\r]+")


def docs(spark, rows, extra=None):
    """Rows (doc_id, text[, source]) with clashing extra columns where asked."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows], DOCS)
    for c in extra or ():
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER)
    want = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


# --- 1, benchmark decontamination


def brute_hits(text, items):
    words = decontamination.plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontamination.plain_words(body)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = list("abc")
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(20)), (2, say(14)), (3, "a b c"), (4, "c"), (5, None), (6, ""), (7, say(13)), (7, say(2)), (10, "a b c a"), (11, "a " * 40)]
    unnamed = [(None, "b a b")]  # matches nothing
    rows = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, items[0][1].upper() + "! x"), (102, items[0][1]), (103, "a " * 90)]
    frame = spark.createDataFrame(items + unnamed, "item_id long, text string")
    for block, sent in ((10**6, 0), (30, 0), (30, 1000)):  # one block, and many
        found = decontamination.find_contamination(docs(spark, rows, ["n_hit", "item_id"]), frame, keep=["doc_id"], block_words=block, broadcast_rows=sent)
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in found.collect())
        want = sorted((d, n, h, tuple(f), h > 0 and 20 * h >= n) for (d, t) in rows for n, h, f in [brute_hits(t, items)])
        assert got == want


def test_decontamination_of_one_word_over_and_over():
    automaton = decontamination.SuffixAutomaton([(1, [b"a"] * 20_000)])
    began = time.process_time()
    assert automaton.scan([b"a"] * 200_000) == ([[0, 200_000]], {1})
    assert time.process_time() - began < 2


def test_decontamination_cuts_and_drops(spark):
    item = " ".join(f"w{i}" for i in range(15))
    clean, dirty = " ".join(f"c{i}" for i in range(400)), item
    mixed = f"{clean}. {item}; tail here"
    out = {r.doc_id: r.text for r in decontamination.decontaminate(docs(spark, [(1, clean), (2, dirty), (3, mixed), (4, None)]), spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    assert out == {1: clean, 3: f"{clean}. tail here", 4: None}
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.decontaminate(docs(spark, [(1, item)]), none).count() == 1


# --- 2, line dedup


def brute_deleted(rows, min_words):
    """Lines of runs of min_words words or more that stand, line by line, at one earlier place."""
    places = [(d, [x for x in (t or "").split("\n")]) for d, t in sorted(rows, key=lambda r: r[0]) if t is not None]
    gone = {}
    for a, (d, lines) in enumerate(places):
        out = set()
        for other, earlier in places[: a + 1]:
            for i in range(len(lines)):
                for j in range(len(earlier)):
                    if other == d and j >= i:
                        break
                    k = 0
                    while i + k < len(lines) and j + k < len(earlier) and lines[i + k] == earlier[j + k] and (other != d or j + k < i):
                        k += 1
                    if k and sum(len(WORD.findall(x)) for x in lines[i : i + k]) >= min_words:
                        out.update(range(i, i + k))
        gone[d] = out
    return gone


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    lines = [" ".join(f"{chr(97 + k)}{j}" for j in range(rng.randint(1, 9))) for k in range(26)]
    runs = [[lines[rng.randrange(26)] for _ in range(rng.randint(3, 8))] for _ in range(6)]
    rows = []
    for d in range(40):
        body = []
        for _ in range(rng.randint(1, 4)):
            body += rng.choice(runs) if rng.random() < 0.5 else [f"own {d} {rng.random()}"]
        rows.append((d, "\n".join(body)))
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, "word " * 50_000), (54, "x\n" + "word " * 50_000)]
    want = brute_deleted(rows, 12)
    for sent in (10**6, 0):
        got = {r.doc_id: set(r.deleted) for r in line_dedup.dedup_lines(docs(spark, rows, ["deleted", "__id2"]), min_words=12, broadcast_rows=sent).collect()}
        assert got == {d: want.get(d, set()) for d, _ in rows}


def test_line_dedup_deletes_only_what_stood_together(spark):
    rows = [(0, "f|e f|c a|a|a|f e"), (1, "e|d|e a|a|c|e|c c"), (2, "c a|a|a b|c|f c|b"), (3, "b|b|e|d|e|d|e|b|a")]
    rows = [(d, t.replace("|", "\n")) for d, t in rows]
    got = {r.doc_id: set(r.deleted) for r in line_dedup.dedup_lines(docs(spark, rows), min_words=5).collect()}
    assert got == brute_deleted(rows, 5) and not got[3]


def test_line_dedup_many_small_sets_against_brute_force():
    """The windows of thousands of small sets of texts, joined here by a dictionary."""
    rng = random.Random(1)
    for _ in range(3000):
        least = rng.choice([1, 2, 3, 5, 8])
        rows = [(d, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 9)))) for d in range(4)]
        places, gone = {}, {d: set() for d, _ in rows}
        for d, t in rows:
            for mark, _, runs in line_dedup.fingerprints(t, least):
                for h, first, last in runs:
                    places.setdefault((mark, h), []).append((d, first, last))
        for spots in places.values():
            early = min(spots)
            for d, first, last in spots:
                if d > early[0] or first > early[2]:
                    gone[d].update(range(first, last + 1))
        assert gone == {d: brute_deleted(rows, least).get(d, set()) for d, _ in rows}


def test_line_dedup_null_and_repeated_keys(spark):
    body = "\n".join(f"line {i} that is repeated" for i in range(20))
    rows = [(None, f"null\n{body}"), (5, body), (5, body), (7, f"a\n{body}"), (7, f"b\n{body}")]
    got = sorted((r.doc_id or 0, r.n_deleted) for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert got == [(0, 0), (5, 20), (5, 20), (7, 20), (7, 20)]
    got = sorted((r.doc_id, r.n_deleted) for r in line_dedup.dedup_lines(docs(spark, rows[1:])).collect())
    assert got == [(5, 0), (5, 0), (7, 20), (7, 20)]
    got = sorted(r.n_deleted for r in line_dedup.dedup_lines(docs(spark, rows[3:])).collect())
    assert got == [0, 20]  # texts of one key are documents in an order of their own


def test_line_dedup_keeps_first_and_short(spark):
    passage = "\n".join(f"line {i} of a passage that is repeated" for i in range(8))
    rows = [(1, f"{passage}\nend one"), (2, f"begin\n{passage}\nend two"), (3, "line 0 of a passage that is repeated"), (4, f"{passage}\nx\n{passage}")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "begin\nend two", 3: rows[2][1], 4: "x"}
    assert line_dedup.dedup_lines(docs(spark, [(1, "a")]).limit(0)).count() == 0


# --- 3, quality rules


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, seen = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            seen.update(range(i, i + 3))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(seen)


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab é#|\n\t ") for _ in range(rng.randint(0, 80)))) for i in range(80)] + [(100, None), (101, "a b c a b c"), (102, "x\nx\n \n \nx"), (103, "a a a a"), (103, "a a a a")]
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs(spark, rows, ["kept", "n_words"]), keep=["doc_id"]).collect())
    assert got == sorted((d, *brute_measures(t)) for d, t in rows)


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, bad, "poor") for i in range(40)] + [(40, good, "poor")] + [(100 + i, good, "fine") for i in range(40)] + [(200, good, None), (201, bad, None), (202, good, "rare")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert got == {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows), broadcast_hosts=0).collect()}
    assert not got[40].kept and not got[40].base_failed and got[40].host_failed
    assert got[100].kept and got[200].kept and got[200].host_rate is None and not got[201].kept
    assert 0 < got[100].host_rate < 0.5 < got[40].host_rate < 1
    assert quality_rules.quality_rules(docs(spark, [(1, "a")]).limit(0)).count() == 0


# --- 4, token counts


def brute_tokens(word, pieces, byte):
    text = token_counts.MARK + word
    best = [(0.0, 0)] + [(-1e18, 0)] * len(text)
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        ways = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        ways += [(best[b][0] + pieces[text[b:end]], best[b][1] - 1) for b in range(end) if text[b:end] in pieces]
        best[end] = max(ways)
    return -best[-1][1]


def test_token_counts_against_brute_force(spark):
    rng = random.Random(4)
    pieces = {"".join(rng.choice("ab▁é") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(60)}
    rows = [(i, " ".join("".join(rng.choice("abéc\u20ac") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 12)))) for i in range(50)] + [(90, None), (91, ""), (92, "ab" * 400)]
    for nodes in (10**6, 20):
        got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs(spark, rows, ["n_tokens"]), pieces, keep=["doc_id"], nodes=nodes).collect()}
        byte = min(pieces.values()) - 10.0
        for d, t in rows:
            words = WORD.findall(t or "")
            assert got[d] == (len(words), sum(brute_tokens(w, pieces, byte) for w in words))


def test_token_counts_of_a_very_long_word():
    pieces = {"a": -1.0, "ab": -1.5, "▁a": -1.0, "b": -2.0, "abab": -2.5}
    trie = token_counts.TokenTrie(pieces)
    word = "".join(random.Random(3).choice("abc") for _ in range(500))
    assert trie.count(token_counts.MARK + word) == brute_tokens(word, pieces, trie.byte_score)
    long = "▁" + "ab" * 50_000
    tracemalloc.start()
    assert trie.count(long) > 0
    assert tracemalloc.get_traced_memory()[1] < 400_000 and len(trie.children) == 1
    tracemalloc.stop()
    with pytest.raises(FileNotFoundError):
        token_counts.read_vocabulary(None, "/nowhere/a.model")


# --- 5, chat formatting


def test_chat_folds_events_and_reads_back(spark):
    hard = "</s>[INST:user]\n \\m\\b[x]\\e"
    log = [
        (1, 0, "m1", "open", "user", ""), (1, 1, "m1", "delta", None, "Hel"), (1, 2, "m1", "delta", None, "lo"), (1, 3, "m2", "open", "assistant", ""), (1, 4, "m2", "delta", None, "wrong"),
        (1, 5, "m2", "regenerate", None, None), (1, 6, "m2", "delta", None, hard), (1, 7, "m1", "edit", None, "Hi"), (1, 8, "m1", "delta", None, "!"), (2, 0, "z", "open", "assistant", None), (None, 0, "n", "open", None, "t"),
    ]
    events = spark.createDataFrame(log, "conv_id int, seq int, msg string, kind string, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(events).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert [(m.role, m.text) for m in got[1].messages] == [("user", "Hi!"), ("assistant", hard)]
    for r in got.values():
        assert [(m.role, m.text) for m in r.messages] == [(t.role, t.text) for t in r.back]
        assert r.formatted.count(chat_format.END) == len(r.messages) == r.formatted.count(chat_format.BEGIN)
    (span,) = got[1].loss_spans
    masked = got[1].formatted[span.start - 1 : span.start - 1 + span.length]
    for plain, safe in reversed(chat_format.ESCAPES):
        masked = masked.replace(safe, plain)
    assert masked == hard and got[2].loss_spans[0].length == 0
    assert chat_format.format_conversations(events.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, 0, "a", "open", "user", "x"), (None, 1, "b", "open", "user", "y")], events.schema)
    assert chat_format.format_conversations(lost).count() == 2  # messages of no conversation


def test_chat_events_of_equal_rows_and_tied_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hm"), (1, 0, "user", "hm"), (1, 1, "assistant", None), (1, 1, "user", "x"), (2, 0, "assistant", "a [INST] b")], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat_format.format_conversations(queries.conversation_events(rows)).collect()}
    assert got == {1: [("user", "hm"), ("user", "hm"), ("assistant", ""), ("user", "x")], 2: [("assistant", "a [INST] b")]}


# --- 6, url filters


def brute_rule(host, path):
    fit = [(len(h + p), h + p, a) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?q#f", "https://example.com/en/8", "ftp://x.net/de/8", "http://a.example.net/de/8/9", "http://b.org/es/", "no scheme", None, "http://", "http://a://b.com/en/", "x://COM/en/", "http://notexample.com/fr/?x=http://z.com/en/"]
    rows = spark.createDataFrame([(i, u, "y") for i, u in enumerate([*urls, urls[0]])], "page_id int, url string, verdict string")
    learn = spark.createDataFrame([("http://q.com/bad/page", True)] * 30 + [("http://q.com/good/page", False)] * 30 + [(None, True), ("http://x/", None)], "url string, bad boolean")
    got = {r.page_id: r for r in url_filters.url_filter(rows, learn, keep=["page_id"], min_support=0.1, min_confidence=0.8).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        rule, action = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (action or "allow"), u
    more = spark.createDataFrame([(1, "http://r.fr/bad/7"), (2, "http://r.fr/good/7"), (3, "http://r.fr/bad/8")], "page_id int, url string")
    out = {r.page_id: r.verdict for r in url_filters.url_filter(more, learn, min_support=0.1, min_confidence=0.8).collect()}
    assert out == {1: "block", 2: "allow", 3: "block"}
    assert out == {r.page_id: r.verdict for r in url_filters.url_filter(more, learn, min_support=0.1, min_confidence=0.8, broadcast_sets=0).collect()}
    assert {r.verdict for r in url_filters.url_filter(more, learn.limit(0)).collect()} == {"allow"}


def test_mined_rules_against_brute_force(spark):
    """Urls of random tokens, of tokens that go together, and of one that all have."""
    rng = random.Random(9)
    names = "alpha beta gamma delta".split()

    def url():
        some = [n for n in names if rng.random() < 0.4] + (["twin", "pair"] if rng.random() < 0.3 else []) + ["all"]
        return "http://h.zz/" + "/".join(some), some

    rows = [url() for _ in range(160)]
    learn = [(u, (("alpha" in t and "beta" in t) or "twin" in t) != (rng.random() < 0.15)) for u, t in rows]
    support, confidence = 0.1, 0.7
    sets = [frozenset(["p:" + x for x in t if x != "all"]) for _, t in rows]
    block = []  # token sets that have a rule
    for k in range(1, 7):
        for some in itertools.combinations(["p:" + x for x in [*names, "twin", "pair"]], k):
            held = [b for s, (_, b) in zip(sets, learn, strict=True) if s.issuperset(some)]
            if held and sum(held) >= support * len(rows) and sum(held) / len(held) >= confidence:
                block.append(set(some))
    more = rows + [("http://h.zz/pair/all", ["pair"]), ("http://h.zz/new", ["new"])]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(more)], "page_id int, url string")
    got = {r.page_id: r.verdict for r in url_filters.url_filter(pages, spark.createDataFrame(learn, "url string, bad boolean"), min_support=support, min_confidence=confidence).collect()}
    want = {i: "block" if any(b <= {"p:" + x for x in t} for b in block) else "allow" for i, (_, t) in enumerate(more)}
    assert got == want and {"block", "allow"} <= set(want.values()) and got[160] == "block"


def test_mining_tokens_that_always_go_together(spark):
    """Thirty tokens on the same urls have 2^30 sets; they are one."""
    same = "/".join(f"{a}{b}x" for a in "abcde" for b in "abcdef")
    learn = spark.createDataFrame([(f"http://q.zz/{same}", True)] * 40 + [("http://q.zz/other", False)] * 40, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://q.zz/abx/new"), (2, "http://q.zz/other")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in url_filters.url_filter(pages, learn).collect()} == {1: "block", 2: "allow"}


# --- 7 and 8, classifiers


def auc(pairs):
    ranked = sorted(pairs)
    n1 = sum(y for _, y in ranked)
    total = sum(i for i, (_, y) in enumerate(ranked, 1) if y) - n1 * (n1 + 1) / 2
    return total / (n1 * (len(ranked) - n1))


@pytest.mark.parametrize("name,label,modulus,left_out,folder,least", [("op7_quality_classifier", "quality", 3, 1, "/root/testdata/sf0.01", 0.97), ("op8_toxicity", "toxic", 4, 2, "/root/testdata/sf0.1", 0.95)])
def test_classifiers_hold_out(spark, name, label, modulus, left_out, folder, least):
    got = {r.doc_id: r for r in queries.queries()[name](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % modulus == left_out) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.5 if label == "quality" else 0.3))
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(got[d].score, y) for d, y in truth.items() if d in got and got[d].held_out and y is not None]
    assert auc(held) > least


@pytest.mark.parametrize("classify,label", [(quality_classifier.classify_quality, "quality"), (toxicity.classify_toxicity, "toxic")])
def test_classifiers_defined_cases(spark, classify, label):
    rows = docs(spark, [(1, None), (2, ""), (3, "a " * 30000), (3, "a"), (None, "x")], ["score", "held_out"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = classify(rows, none, keep=["doc_id"]).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1), (3, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert classify(rows, odd, keep=["doc_id"]).count() == 5
    assert classify(rows.limit(0), odd).count() == 0


def test_sample_takes_one_row_an_id(spark):
    rows = docs(spark, [(1, None)] + [(1, f"text {i}") for i in range(2000)] + [(2, "b " * 50_000), (3, None)])
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.text for r in bounded_labels(rows, marks, "toxic", "doc_id", "text", 10**9, 0, 100).collect()}
    assert set(got) == {1, 2, 3} and got[1].startswith("text") and len(got[2]) == 100_000 and got[3] is None
    assert len(toxicity.trained(rows, marks, modulus=10**9, left_out=0)[1]) <= 3


def test_toxicity_thresholds_cover_all_labelled_texts(spark):
    """A small sample to fit on: languages that it hardly holds, and one of long texts alone, have thresholds from all their texts."""
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        lang, bad = ("aa", "aa", "aa", "bb", "cc")[i % 5], rng.random() < 0.3
        words = [f"w{rng.randrange(40)}" for _ in range(3_001 if lang == "cc" else 20)]
        for _ in range(rng.randrange(2) + 2 * bad):
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "odd"])
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(bad)))
    texts, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.classify_toxicity(texts, labels, keep=["doc_id", "lang"], per_class=30).collect()
    fitted = set(toxicity.trained(texts, labels, per_class=30)[1])
    assert 0 < len(fitted) <= 60
    levels = {r.lang: r.lang_threshold for r in got}
    for lang in ("aa", "bb", "cc"):
        mine = [(r.score, marks[r.doc_id][1]) for r in got if r.lang == lang and not r.held_out and r.doc_id not in fitted]
        assert len(mine) > 90

        def f1(level, mine=mine):
            return 2 * sum(y for s, y in mine if s >= level) / (sum(s >= level for s, _ in mine) + sum(y for _, y in mine))

        assert levels[lang] != 0.3 and f1(levels[lang]) >= max(f1(k / 1000) for k in range(50, 951)) - 1e-9


def test_factorisation_machine_identity():
    import numpy as np

    fm = quality_classifier.FactorisationMachine(size=12, rank=3, seed=1)
    fm.w[:] = np.arange(12) / 10
    x, v = np.array([1, 4, 7, 9]), np.array([0.5, -1.0, 2.0, 0.25])
    pairs = sum((fm.v[x[i]] @ fm.v[x[j]]) * v[i] * v[j] for i in range(4) for j in range(i + 1, 4))
    assert fm.raw(x, v) == pytest.approx(fm.w[x] @ v + pairs)


# --- 9, mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, full, left = list(order), {}, 1.5 * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > 2 * sizes[s]]
        if not over:
            return full | {s: left * weights[s] / total for s in free}
        for s in over:
            full[s] = 2 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())
        free = [s for s in free if s not in over]
    return full


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))), rng.choice(["b", "a", "a", "a", "c", "d", None])) for i in range(700)] + [(900, None, "a"), (901, "", "e"), (902, "x " * 5000, "a"), (903, "dup dup", "c"), (903, "dup dup", "c")]
    runs = [sorted(tuple(r[c] if r[c] is not None else "" for c in ("doc_id", "size", "source", "source_size", "target", "taken")) for r in mixing.mix(docs(spark, rows, ["taken"]).repartition(n), shard_docs=50, keep=["doc_id", "source"]).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    aims, taken = brute_targets(sizes), Counter()
    for r in mixing.mix(docs(spark, rows), shard_docs=50).collect():
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(aims[r.source])
        taken[r.source] += r.taken
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= 48 + 0.02 * aim
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def test_apportionment_against_highest_quotients(spark):
    rng = random.Random(6)
    for n, seats in ((1, 7), (6, 40), (30, 500), (9, 3)):
        votes = [float(rng.choice([0, 1, 1, 5, 80, rng.randrange(5000)])) for _ in range(n)]
        frame = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "name int, votes double, seats long")
        got = {r.name: r.quota for r in mixing.sainte_lague(frame, F.col("seats"), "votes", ["name"], [], F.lit(10**6)).collect()}
        want = Counter({i: 0 for i in range(n)})
        for _ in range(seats if sum(votes) else 0):
            want[max(range(n), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert got == want, votes


# --- 10, n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").encode().lower().decode())  # A-Z alone
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(rng, n_groups, copies):
    rows = []
    for g in range(n_groups):
        words = [f"g{g}w{rng.randrange(200)}" for _ in range(rng.randint(5, 120))]
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append(" ".join(w).title() if rng.random() < 0.3 else " ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block_sets", [2000, 6])
def test_jaccard_against_brute_force(spark, block_sets):
    rng = random.Random(21)
    rows = near_copies(rng, 8, 14)
    rows += [(500 + i, t) for i, t in enumerate([None, "", "one", "ONE", "one two three", "one two three four", "a b c d e", " \n\t", "One Two Three"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, rows, ["n_shingles"]), block_sets=block_sets).collect()}
    assert got == brute_components(rows)


def test_jaccard_chain_in_one_large_cluster(spark):
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(40):  # each is linked with the next alone
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(200)] = f"x{i}{rng.random()}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, rows), block_sets=5, broadcast_rows=0).collect()}
    assert got == brute_components(rows)
    assert {r.doc_id for r in jaccard_join.one_of_each_group(docs(spark, rows)).collect()} == {c for _, c in got.values()}


def test_jaccard_unlike_texts_with_a_shared_passage(spark):
    """Half of each text is one passage: no links but the few planted, and no task holds all sets."""
    rng = random.Random(14)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"{i}x{rng.random()}" for _ in range(30))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, rows), block_sets=20).collect()}
    assert {d: c for d, (_, c) in got.items() if d != c} == {1000 + i: i for i in range(5)}


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 900)] + [(899, 1000)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001), (None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(900), *range(1000, 1041)]} | {5000: 5000, 5001: 5000}


def test_jaccard_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2, text), (2, text), (1, text), (3, None), (3, None)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, rows)).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3), (3, 3)]
    assert jaccard_join.jaccard_components(docs(spark, rows).limit(0)).count() == 0



def test_blocks_of_repeated_items_are_bounded(spark):
    """Items that share a text are one piece; the ids of very many are parted; no block outgrows its bound."""
    words = " ".join(f"w{i}" for i in range(100))
    items = [(i, words) for i in range(50)] + [(100 + i, f"x{i} " * 30 + words) for i in range(10)] + [(900 + i, "short one") for i in range(700)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontamination.item_blocks(frame, "item_id", "text", 13, 100))
    assert len(blocks) > 10 and max(sum(len(ids) + len(w) for ids, w in b) for b in blocks) <= 400
    pieces = [(i, tuple(w)) for b in blocks for ids, w in b for i in ids]
    assert len(pieces) == len(set(pieces)) and {i for i, _ in pieces} == {str(i) for i, _ in items}
    rows = [(1, words), (2, "a short one b"), (3, "x3 " * 30), (4, None)]
    got = {r.doc_id: (r.n_hit, len(r.item_ids)) for r in decontamination.find_contamination(docs(spark, rows), frame, block_words=100).collect()}
    assert got == {1: (100, 60), 2: (2, 700), 3: (30, 1), 4: (0, 0)}


def test_rules_on_nearly_shared_tokens(spark):
    """Tokens that are on nearly all urls are mined like others, and rules are compared with shorter ones alone."""
    rng = random.Random(3)
    names = [a + b for a in "abc" for b in "wxyz"]
    rows = [[n for n in names if rng.random() < 0.94] for _ in range(300)]
    learn = [("http://q.zz/" + "/".join(t), ("aw" not in t and "bx" in t) or rng.random() < 0.03) for t in rows]
    frame = spark.createDataFrame(learn, "url string, bad boolean").select(url_filters.url_tokens(F.col("url")).alias("tokens"), "bad")
    groups = url_filters.token_groups(frame, 0.01)
    assert {r.token for r in groups.collect()} == {f"p:{n}" for n in names}  # those of the host are on all
    found = {tuple(r.rule_tokens): (r.confidence, r.n_tokens) for r in url_filters.mined_rules(frame.select(F.expr("filter(tokens, t -> t like 'p:%')").alias("tokens"), "bad"), min_support=0.01, min_confidence=0.05).collect()}
    sets, want, short = [frozenset(t) for t in rows], {}, {}
    for k in range(1, len(names) + 1):
        for some in itertools.combinations(names, k):
            held = [b for s, (_, b) in zip(sets, learn, strict=True) if s.issuperset(some)]
            if len(held) < 3:
                continue
            short[some] = max([-1.0, *[max(short[x], conf[x]) for x in itertools.combinations(some, k - 1) if x]]) if k > 1 else -1.0
            conf = locals().get("conf", {})
            conf[some] = sum(held) / len(held) if sum(held) >= 3 else 0.0
            if conf[some] >= 0.05 and conf[some] > short[some]:
                want[tuple("p:" + x for x in some)] = (pytest.approx(conf[some]), k)
    assert found == want


def test_toxicity_with_a_dirty_language_column(spark):
    rng = random.Random(1)
    rows = [(i, "vile thing " * 5 if i % 3 == 0 else f"calm day {rng.randrange(9)} " * 5, f"l{i}" if i % 2 else "en") for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify_toxicity(texts, labels, keep=["doc_id", "lang"], per_class=60, least=20).collect()}
    assert len(got) == 400 and all(r.lang_threshold == 0.3 for r in got.values() if r.lang != "en")
    assert {r.rejected for d, r in got.items() if d % 3 == 0} == {True}


def test_sample_is_bounded_by_code_points(spark):
    rows = docs(spark, [(i, "x" * 1000) for i in range(50)] + [(100, "y" * 100_000), (101, None)])
    marks = spark.createDataFrame([(i, i % 2) for i in [*range(50), 100, 101]], "doc_id long, toxic int")
    got = bounded_labels(rows, marks, "toxic", "doc_id", "text", 10**9, 0, 100, 5_500).collect()
    for label in (0, 1):
        assert sum(len(r.text or "") for r in got if r["__label"] == label) <= 5_500
    whole = bounded_labels(rows, marks, "toxic", "doc_id", "text", 10**9, 0, 100, 10**7).count()
    assert whole == 52 and len(got) >= 5


@pytest.mark.parametrize("sent", [10**6, 0])
def test_jaccard_sets_whose_names_clash(spark, sent):
    """With names of three bits nearly all sets share theirs, and the second hash tells them apart."""
    rng = random.Random(30)
    rows = near_copies(rng, 6, 10) + [(900, None), (901, "")]
    found = jaccard_join.jaccard_components(docs(spark, rows), bits=3, broadcast_rows=sent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)
