"""Prefix trie, personal data and turn repair against brute force on small tables, and their defined cases."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyroom.llm import pii, prefix_trie, queries, structure_repair

TURNS = "conv_id long, turn long, role string, text string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def by_conversation(rows, null):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, null if role is None else role, null if text is None else text))
    return {c: [(r, x, t if known else None) for known, t, r, x in sorted(v, key=lambda y: (y[0], y[1], y[2], digest(y[3])))] for c, v in out.items()}


# --- 11, prefix trie


def brute_trie(conversations):
    """{(conv_id, depth): the other columns} of {conversation: [(role, text), ...]}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in children[node]) or 1
        saved = sum(sums[k][1] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        sums[node] = leaves, saved
    joined = lambda node: ",".join(map(str, sorted(ends[node])))
    return {
        (min(m), len(node)): (min(members[node[:-1]]) if node else None, len(m), len(children[node]), *sums[node], digest(joined(node))) for node, m in members.items()
    }


def trie_rows(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def some_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    rows += [(1000, t, "user", "a") for t in range(40)] + [(1001, t, "user", "a") for t in range(37)] + [(None, 0, "user", "a")]
    return rows


@pytest.mark.parametrize("block", [4096, 4])  # in one block, and in blocks of four turns
def test_trie_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = some_conversations(3, 60)
    want = brute_trie({c: [(r, x) for r, x, _ in v] for c, v in by_conversation(rows, "").items()})
    got = prefix_trie.trie_of(spark.createDataFrame(rows, TURNS).withColumns({"place": F.lit("x"), "a": F.lit(1)}))
    assert trie_rows(got) == want and got.count() == len(want)


def test_trie_with_hubs_that_are_sent(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HUBS", 1)
    rows = [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(300) for t in range(2)]
    want = brute_trie({c: [(r, x) for r, x, _ in v] for c, v in by_conversation(rows, "").items()})
    assert trie_rows(prefix_trie.trie_of(spark.createDataFrame(rows, TURNS))) == want


def test_rebuilt_trie_against_brute_force(spark, tmp_path):
    rows = some_conversations(4, 80)
    own = {c: [(r, x) for r, x, _ in v] for c, v in by_conversation(rows, "").items()}
    cut = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    want = brute_trie({c: own.get(c - c % 5, [])[: cut[c]] + v[cut[c] :] for c, v in own.items()})
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie_rows(queries.op11_prefix_trie(spark, str(tmp_path))) == want


def test_trie_of_none(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie_of(none).count() == 0


def test_trie_of_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 3_000_000), (2, 0, "user", "x" * 3_000_000), (2, 1, "user", "")]
    got = trie_rows(prefix_trie.trie_of(spark.createDataFrame(rows, TURNS)))
    assert got[1, 1][:5] == (1, 2, 1, 1, 3_000_000) and got[2, 2][:5] == (1, 1, 0, 1, 0)


# --- 12, personal data

FINDERS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: good_card(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def good_card(digits: str) -> bool:
    total = 0
    for k, d in enumerate(digits[::-1]):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return 12 <= len(digits) <= 19 and total % 10 == 0


def brute_base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(FINDERS) for m in p.finditer(text or "") if good(m.group())]
    return [(a, b, FINDERS[k][0]) for a, k, b in sorted(found)]


def odd_texts():
    rng = random.Random(9)
    signs = ["a.@-1é ", "12. ", "0123456789 -", "+12 ().-", "+a1.@", "0. ", "http://a@~/", "token= 1a"]
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in signs for _ in range(400)]


def test_base_kinds_against_patterns(spark):
    texts = [*odd_texts(), None, "", "4111 1111-1111 1111, 255.255.0.1.2.3.4.5 and 256.1.1.1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"spans": F.lit("clash"), "N_EMAIL": F.lit(1)})
    out = pii.find_pii(rows, keep=["doc_id", "spans"]).collect()
    assert len(out) == len(texts)
    for r in out:
        base = [(s["start"], s["end"], s["kind"]) for s in r.spans if s["kind"] in pii.KINDS[: pii.BASE]]
        assert base == brute_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in pii.KINDS[: pii.BASE])


def test_what_the_method_adds(spark):
    text = 'token = "9b0b3c6a43eb", IBAN: DE89 3704 0044 0532 0130 00. IBAN DE89370400440532013001; https://bob:pw1@x.org/a, http://x.org/~bob. http://x.org/ API_KEY=abc12x; account of 1234567'
    row = pii.find_pii(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [text[s["start"] : s["end"]] for s in row[0].spans] == ["9b0b3c6a43eb", "DE89 3704 0044 0532 0130 00", "https://bob:pw1@x.org/a", "pw1@x.org", "http://x.org/~bob", "abc12x"]
    assert row[0].redacted == 'token = "[ACCOUNT]", IBAN: [ACCOUNT]. IBAN DE89370400440532013001; [URL], [URL]. http://x.org/ API_KEY=[ACCOUNT]; account of 1234567'
    assert (row[1].spans, row[1].redacted, row[2].redacted) == ([], None, "")


def test_own_cues(spark):
    rows = spark.createDataFrame([(1, "Badge no: 77-1234 token=abc1234")], "doc_id long, text string")
    assert [(s["start"], s["end"]) for s in pii.find_pii(rows, cues=["badge"]).first().spans] == [(10, 17)]


def test_long_texts_in_linear_time():
    automaton = pii._automaton(pii.CUES)
    began = time.process_time()
    for text in ("1" * 2_000_000, "1." * 500_000, "a@" * 500_000, "+1 " * 300_000, "http://" * 200_000, "token=" * 200_000, "a" * 2_000_000 + "@b.c"):
        pii.spans_of(text, automaton)
    assert time.process_time() - began < 30


# --- 13, turn repair

STATES = {("S", "s"): "s", ("S", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_repair(turns):
    """(cost, edits, lines) over all edits of [(role, text, fault)]; at most three inserts in a row, as a fourth comes back."""

    @functools.cache
    def best(i, state, inserts):
        out = []
        due, name = ("a", "assistant") if state == "u" else ("u", "user")
        if i == len(turns):
            if state in "Sa":
                out.append((0, "", ()))
        else:
            role, text, fault = turns[i]
            c, e, lines = best(i + 1, state, 0)
            out.append((c + 3, "D" + e, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in STATES:
                    c, e, lines = best(i + 1, STATES[state, role[:1]], 0)
                    out.append((c + more, "K" + e, (f"{role}:{text}", *lines)))
                c, e, lines = best(i + 1, due, 0)
                out.append((c + 2 + more, "R" + e, (f"{name}:{text}", *lines)))
        if inserts < 3:
            c, e, lines = best(i, due, inserts + 1)
            out.append((c + 2, "I" + e, (f"{name}:", *lines)))
        return min(out) if out else (10**9, "", ())

    return best(0, "S", 0)


def brute_audit(turns):
    """The query's columns but for the conversation, of [(role, text, turn)] in order."""
    seen, faults = set(), []
    for role, text, _ in turns:
        words = re.findall("[^ \t-\r]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for *_, t in turns if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, edits, lines = brute_repair(tuple((r, x, f) for (r, x, _), f in zip(turns, faults, strict=True)))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, digest("\n".join(lines))


def odd_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        for t in range(rng.choice([0, 1, 2, 3, 6, 10])):
            number = rng.choice([t, t, t, None, 3 * t])
            rows.append((c, number, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["a.", "b", "c!", "", " \n", None, "x?  ", "ü."])))
    return [*rows, (None, 1, "user", "a."), (700, 1, "user", "a."), (700, 1, "user", "a."), (701, None, None, None)]


def told(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("cells", [structure_repair.CELLS, 16])
def test_repair_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(structure_repair, "CELLS", cells)
    rows = odd_conversations(6)
    frame = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit("x"), "CODE": F.lit(1)})
    audits, digests = structure_repair.repair_conversations(frame, digests=True)
    want = {c: brute_audit(v) for c, v in by_conversation(rows, " ").items()}
    assert told(audits.join(digests, "conv_id")) == want
    _, turns = structure_repair.repair_conversations(frame)
    lines = defaultdict(list)
    for r in turns.orderBy("conv_id", "place").collect():
        lines[r.conv_id].append((r.role, r.text))
    for c, v in lines.items():
        assert re.fullmatch("s?(ua)+", "".join(role[0] for role, _ in v))
        assert digest("\n".join(f"{r}:{x}" for r, x in v)) == want[c][-1]
    assert {c for c, v in want.items() if v[-1] == digest("")} == set(want) - set(lines)


def test_damaged_repair_against_brute_force(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t}" + ".!? "[(c + t) % 4]) for c in range(60) for t in range(c % 9)]
    rows += [(c, None, None, None) for c in range(100, 120)] + [(c, 0, "user", "x.") for c in range(200, 300)]
    hurt = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        crc = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if crc == 1 else re.sub("[.!?]", "", text) if crc == 2 else text
        hurt[c] += [] if crc == 0 else [("user" if crc == 4 else role, text, t)] * (2 if crc == 3 else 1)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(queries.op13_structure_repair(spark, str(tmp_path))) == {c: brute_audit(v) for c, v in hurt.items()}
    assert any(not v for v in hurt.values())


def test_repair_of_none_and_of_long_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    audits, turns = structure_repair.repair_conversations(none)
    assert audits.count() == turns.count() == 0
    rows = spark.range(6000).selectExpr("id div 6000 AS conv_id", "id AS turn", "CASE id % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '.') AS text")
    rows = rows.union(spark.createDataFrame([(1, 0, "user", "word " * 400_000 + ".")], TURNS))
    audits, _ = structure_repair.repair_conversations(rows, digests=True)
    assert {r.conv_id: (r.cost, len(r.audit)) for r in audits.collect()} == {0: (0, 6000), 1: (2, 2)}
