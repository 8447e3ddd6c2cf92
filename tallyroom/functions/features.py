"""What a text is learned by, computed in a task: tokens, runs of them, and what is odd about the form.

The tokens are those of ``text.feature_tokens``; plain functions on a string, for use in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter

from tallyroom.functions.text import NAMED

_SPLIT = re.compile(r"[\w+.#/-]+")
_NAMED = [(pattern.replace("\\", ""), re.compile(rf"(?:^|[\W_]){pattern}(?=$|[\W_])"), f" {name} ") for pattern, name in NAMED]
_BRACKETS, _DASHES = re.compile(r"\[[^\]]+\]"), str.maketrans("–—", "--")
_RUN, _LINE, _WIDE = re.compile(r"[^\W_]+"), re.compile(r"\r?\n"), re.compile(r"[^\x00-\x7F]")
_LEET = re.compile(r"[^\W\d_][0-9][^\W\d_]|[0-9][^\W\d_]{2,}|[^\W\d_]{2,}[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_LETTERS = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())
#: Tokens whose clean form a task remembers.
REMEMBERED = 200_000


class Tokens(dict):
    """Raw tokens and what they come to; an empty string for none."""

    def __missing__(self, raw: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        t = raw.strip("+./-")
        if not 2 <= len(t) <= 48 or t.startswith("www.") or not any(map(str.isalpha, t)):
            t = ""
        self[raw] = t
        return t


def tokens(text: str | None, known: Tokens) -> list[str]:
    low = (text or "").lower()
    for said, pattern, name in _NAMED:
        if said in low:
            low = pattern.sub(name, low)
    low = low.translate(_DASHES) if not low.isascii() else low
    low = _BRACKETS.sub(" ", low) if "[" in low else low
    return [t for t in map(known.__getitem__, _SPLIT.findall(low.replace("_", " "))) if t]


def runs(words: list[str], most: int) -> set[str]:
    """The distinct runs of 1 to ``most`` words."""
    out = set(words)
    for n in range(2, most + 1):
        out.update(map(" ".join, zip(*[words[k:] for k in range(n)], strict=False)))
    return out


def marks(text: str | None, words: list[str]) -> list[str]:
    """Names of what is odd about a text's form: few letters, many signs, digits in words, tiny lines, repeats, shortness.

    words: the text's tokens.
    """
    body = text or ""
    wide = _WIDE.findall(body)
    visible = len(body) - sum(map(body.count, " \t\n\x0b\f\r"))
    letters = len(body.encode("ascii", "ignore").translate(None, _NO_LETTERS)) + sum(map(str.isalpha, wide))
    leet = 0
    if _DIGIT.search(body):
        # numbers that are neither letters nor decimal digits part words here
        odd = {ord(c): "_" for c in set(wide) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
        leet = sum(len(_LEET.findall(run)) for run in _RUN.findall(body.translate(odd) if odd else body) if _DIGIT.search(run))
    lines = [x for x in (x.strip(" ") for x in _LINE.split(body)) if x]
    often = sum(n for n in Counter(words).values() if n >= 5) if len(words) >= 8 else 0
    # fixed values: the limits and what they are called
    found = [
        ("__meta_low_alpha_ratio__", (letters / visible if visible else 0.0) < 0.58),
        ("__meta_weird_symbol_density__", (sum(map(body.count, "©®�|\\_=<>")) / visible if visible else 0.0) > 0.02),
        ("__meta_leetspeak_or_ocr_substitution__", leet >= 2),
        ("__meta_tiny_line_burst__", sum(len(x) <= 3 for x in lines) > 0.18 * len(lines)),
        ("__meta_repetition_burst__", often > 0.22 * len(words)),
        ("__meta_very_short_document__", len(body) < 300),
        ("__meta_short_document__", 300 <= len(body) <= 699),
    ]
    return [name for name, is_so in found if is_so]


def features(text: str | None, known: Tokens, most: int = 3, meta: bool = True) -> list[str]:
    """The distinct runs of 1 to ``most`` tokens of a text, and the names of what is odd about its form."""
    words = tokens(text, known)
    return [*runs(words, most), *(marks(text, words) if meta else [])]
