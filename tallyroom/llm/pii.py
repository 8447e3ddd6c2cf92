"""Personal data by anchor expansion: an automaton finds anchors, local parsers find and validate what stands around them.

An Aho-Corasick automaton reads a text once and reports at-signs, schemes' ``://``, signs of phone numbers, digits and
cues of identifiers.  At each anchor a parser that depends on the kind alone expands to the left and to the right, and
validates: domains have a dot, parts of addresses are at most 255, cards pass Luhn, IBANs have remainder 1.  A parser
never reads behind the end of its kind's last find, so all of them together read a text a bounded number of times.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import field, map_texts

#: Kinds in the order in which spans of one start are told; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "url", "account"]
BASE = 4
#: What is followed by an identifier, in lower case; none is a part of another.  ``iban`` has a parser of its own.
CUES = ["account", "acct", "passport", "ssn", "tax id", "token", "password", "passwd", "secret", "api key", "api_key", "apikey", "user id", "user_id", "login"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = LOCAL - frozenset("_%")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"[0-9][ ().0-9-]++")
_URL = re.compile(r"[^\x00-\x20<>\"']*+")
_PERSONAL = re.compile(r"://[^/?#@]+@|/(?:~|@|u/|users?/|profiles?/|people/)[A-Za-z0-9]")
_VALUE = re.compile(r"(?:[ _-]?(?:no|number|nr|id|key|code))?\.?[ \t]*[:=#][ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9._/+-]*)")
_IBAN = re.compile(r"[:=# ]*([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))")
_NO_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, its digits added; the sum ends in 0."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def iban(value: str) -> bool:
    """The first four signs go to the end, letters count from 10; the remainder by 97 is 1."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _email(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    first = at
    while first > done and text[first - 1] in LOCAL:
        first -= 1
    domain = _DOMAIN.match(text, at + 1) if first < at else None
    if domain:
        yield first, domain.end(), True


def _ip(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    found = _IP.match(text, at)
    if found:
        yield at, found.end(), all(map(small_part, found.group().split(".")))
        return
    end = at + 1
    while end < len(text) and "0" <= text[end] <= "9":
        end += 1
    yield at, end, False  # the rest of a run can't begin what the whole can't


def _card(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    found = _CARD.match(text, at)
    if found:
        digits = found.group() if found.end() - at > 40 else _NO_DIGIT.sub("", found.group())
        yield at, found.end(), 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    found = _PHONE.match(text, at + 1)
    body = found.group().rstrip(" ().-") if found else ""
    if len(body) > 2:  # a digit, something between, a digit
        yield at, at + 1 + len(body), 9 <= len(_NO_DIGIT.sub("", body)) <= 15


def _url(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    first = at
    while first > done and text[first - 1] in SCHEME:
        first -= 1
    while first < at and text[first] not in LETTERS:
        first += 1
    if first < at:
        end = _URL.match(text, at).end()
        body = text[at:end].rstrip(".,;:!?)]}")
        yield first, end, False
        if _PERSONAL.search(body):
            yield first, at + len(body), True


def _account(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    found = _VALUE.match(text, at)
    if found:
        value = found.group(1).rstrip("._/+-")
        yield at, found.end(), False
        if len(value) > 5 and any("0" <= c <= "9" for c in value):
            yield found.start(1), found.start(1) + len(value), True


def _iban(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    found = _IBAN.match(text, at)
    if found:
        yield found.start(1), found.end(), iban(found.group(1))


def _automaton(cues: list[str]):
    """Patterns with what they announce: (parsers, what is to be added to the end of the anchor to get its place)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ((0, "email", _email),))
    for d in "0123456789":
        found.add_word(d, ((0, "ip", _ip), (0, "card", _card)))
        found.add_word("+" + d, ((-1, "phone", _phone),))
    found.add_word("://", ((-2, "url", _url),))
    for cue in cues:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ((1, "account", _account),))
    for form in ("iban", "Iban", "IBAN"):
        found.add_word(form, ((1, "iban", _iban),))
    found.make_automaton()
    return found


def spans_of(text: str | None, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed, then end; code points, the end exclusive."""
    if not text:
        return []
    done = dict.fromkeys(["email", "ip", "card", "phone", "url", "account", "iban"], 0)
    spans = []
    for end, parsers in automaton.iter(text):
        for shift, kind, parse in parsers:
            at = end + shift
            # an anchor within the kind's last find is not looked at again; a cue counts from its first sign
            if at < done[kind]:
                continue
            for first, last, good in parse(text, at, done[kind]):
                done[kind] = max(done[kind], last)
                if good:
                    spans.append((first, last, "account" if kind == "iban" else kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return spans


def find_pii(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, cues: list[str] | None = None, redact: bool = True) -> DataFrame:
    """Append spans (array of kind, start, end), n_email, n_ip, n_card, n_phone, n_url, n_account and redacted, the text with [KIND] for what was found.

    Base kinds are found leftmost, non-overlapping by kind; a find that fails its validation is dropped and not sought
    again within.  Spans of different kinds may overlap; in the redacted text they make one gap, named by the first.
    A url counts if it names a user (``user@`` before its host, or a user's path); an identifier if a cue, a sign and a
    value of 6 signs with a digit follow one another, an IBAN if its check digits hold.

    Defined cases: a null text has no spans and a null redacted text; an empty one none and an empty one.  Rows are
    independent, so repeated ids, ties and extra columns change nothing; a column with the name of a result is replaced.
    cues: words before identifiers, told in lower case and met in lower, capitalised or upper case; none may be a part
    of another.  redact: False leaves the redacted text out.  One pass, no shuffle.
    """
    words = list(CUES if cues is None else cues)

    def make() -> Callable[[list], list[tuple]]:
        automaton = _automaton(words)

        def run(texts: list) -> list[tuple]:
            out = []
            for t in texts:
                spans = spans_of(t, automaton)
                kinds = [s[2] for s in spans]
                out.append(([{"kind": k, "start": a, "end": b} for a, b, k in spans], *[kinds.count(k) for k in KINDS], *([redacted(t, spans)] if redact else [])))
            return out

        return run

    fields = [field("spans", "array<struct<kind:string,start:bigint,end:bigint>>"), *[field(f"n_{k}", "long") for k in KINDS], *([field("redacted", "string")] if redact else [])]
    return map_texts(docs, text, fields, make, keep)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for first, last, kind in spans:
        if first >= at:
            parts += [text[at:first], f"[{kind.upper()}]"]
        at = max(at, last)
    return "".join([*parts, text[at:]])


def told(spans: str, base: bool) -> F.Column:
    """``kind:start:end``, comma-joined; only the base kinds if asked."""
    some = F.filter(spans, lambda s: s["kind"].isin(KINDS[:BASE])) if base else F.col(spans)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
