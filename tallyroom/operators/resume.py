"""Profiles from plain text: a machine over lines, with a parser for each kind of section.

A heading changes the section and stays in force until the next one; lines of sections that are ignored (consents) go
nowhere.  Within a section lines open entries or belong to the open one.  One pass over a text's lines, one nested row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyroom.operators.dictionary import folded

_IN_YEAR = re.compile("(?:19|20)[0-9]{2}")  # every range has one
MONTHS = {m: k // 3 for k, m in enumerate("jan sty january feb lut february mar marzec march apr kwi april may maj maja jun cze june jul lip july aug sie august sep wrz september oct paz october nov lis november dec gru december".split())}
_YEAR = "(?:19|20)[0-9]{2}"
_DATE = rf"(?:{_YEAR} ?[./-] ?(?:1[0-2]|0?[1-9])(?![0-9])|(?:1[0-2]|0?[1-9]) ?[./-] ?{_YEAR}|(?:{'|'.join(sorted(MONTHS, key=len, reverse=True))})\.? {_YEAR}|{_YEAR})"


@dataclass(frozen=True)
class Words:
    """What lines are told apart by, folded; lists of our own."""

    headings: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "experience": ("experience", "work experience", "professional experience", "employment", "doswiadczenie", "doswiadczenie zawodowe"),
        "education": ("education", "edukacja", "wyksztalcenie"), "certificates": ("certificates", "certifications", "courses", "certyfikaty", "kursy", "szkolenia"),
        "languages": ("languages", "foreign languages", "jezyki", "jezyki obce"), "projects": ("projects", "portfolio", "projekty"),
        "skills": ("skills", "technical skills", "umiejetnosci", "kompetencje"), "summary": ("summary", "about me", "profile", "podsumowanie", "o mnie"),
        "ignored": ("consent", "gdpr", "rodo", "klauzula"),
    })
    roles: tuple[str, ...] = ("developer", "engineer", "manager", "operator", "welder", "driver", "analyst", "technician", "specialist", "programista", "spawacz", "kierowca", "kierownik", "specjalista")
    firms: tuple[str, ...] = ("ltd", "inc", "gmbh", "llc", "company", "group", "firma", "zaklad", "spolka", "bank")
    degrees: tuple[str, ...] = ("bachelor", "master", "phd", "bsc", "msc", "engineer's", "inzynier", "magister", "licencjat", "technik")
    schools: tuple[str, ...] = ("university", "college", "academy", "school", "institute", "uniwersytet", "politechnika", "akademia", "technikum", "liceum")
    levels: tuple[str, ...] = ("a1", "a2", "b1", "b2", "c1", "c2", "native", "fluent", "basic", "ojczysty", "biegly", "podstawowy")
    now: tuple[str, ...] = ("present", "now", "current", "obecnie", "nadal", "teraz")


@dataclass
class Dates:
    first: int | None = None
    last: int | None = None
    current: bool = False
    rest: str = ""


_PART = {"role": "string", "company": "string", "first": "int", "last": "int", "current": "boolean", "description": "string", "highlights": "array<string>"}
_struct = lambda fields: "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">>"
SCHEMA = {
    "name": "string", "summary": "string", "experience": _struct(_PART), "education": _struct({"degree": "string", "institution": "string", "first": "int", "last": "int"}),
    "certificates": _struct({"name": "string", "issuer": "string", "year": "int"}), "languages": _struct({"language": "string", "level": "string"}),
    "projects": _struct({"name": "string", "tools": "array<string>", "description": "string"}), "skills": "array<string>",
}


def month_of(text: str) -> int | None:
    """Months since year 0 of a date; a year alone is its January."""
    year = re.search(_YEAR, text)
    if not year:
        return None
    rest = (text[: year.start()] + " " + text[year.end() :]).strip(" ./-")
    month = int(rest) - 1 if rest.isdigit() else MONTHS.get(rest.strip(". "), 0)
    return int(year.group()) * 12 + month


@cache
def _any_of(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words, whole; compiled once."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words)) or '(?!)'})(?!\w)")


class Reader:
    """The machine for one text."""

    def __init__(self, words: Words) -> None:
        self.words = words
        self.headings = {h: s for s, some in words.headings.items() for h in some}
        self.range = re.compile(rf"(?<![0-9])({_DATE}) ?(?:[-–—]| do | to ) ?({_DATE}|{'|'.join(words.now)})(?![0-9\w])")
        self.single = re.compile(rf"(?<![0-9]){_DATE}(?![0-9])")

    def _has(self, text: str, words: tuple[str, ...]) -> bool:
        return _any_of(words).search(folded(text)[0]) is not None

    def heading(self, line: str) -> tuple[str, str] | None:
        """(section, what follows a colon on the line), None for no heading."""
        bare = re.sub(r"^(?:[0-9]{1,2}[.)]|[IVX]+[.)])\s*", "", line.strip(" \t#*•–—_=~>-"))
        head, colon, rest = bare.partition(":")
        section = self.headings.get(folded(head.strip())[0]) if len(head) < 60 else None
        return (section, rest.strip()) if section and (not rest or colon) else None

    def dates(self, line: str) -> Dates | None:
        """The line's range of dates, and the line without it."""
        low, places = folded(line)
        found = self.range.search(low) if _IN_YEAR.search(low) else None
        if not found:
            return None
        at = (lambda k: (places[k] if k < len(places) else len(line)) if places else k)
        rest = (line[: at(found.start())] + line[at(found.end()) :]).replace("()", "").strip(" ,;|:()-–—\t")
        last = month_of(found.group(2))
        return Dates(month_of(found.group(1)), last, last is None, rest)

    def role_and_company(self, text: str) -> tuple[str, str]:
        """Parted at a dash, bar, dot, comma, ``at`` or ``w``; words of roles and firms tell which is which, else the firm comes first."""
        for separator in (r"\s+[-–—]\s+|\s*[|·•]\s*|\s+(?:at|w)\s+", r",\s*"):
            parts = [p.strip() for p in re.split(separator, text) if p.strip()]
            if len(parts) < 2:
                continue
            a, b = parts[:2]
            roles, firms = [self._has(p, self.words.roles) for p in (a, b)], [self._has(p, self.words.firms) for p in (a, b)]
            if roles[0] != roles[1]:
                return (a, b) if roles[0] else (b, a)
            if firms[0] != firms[1]:
                return (b, a) if firms[0] else (a, b)
            if separator != r",\s*":
                return b, a
        text = text.strip()
        return (text, "") if self._has(text, self.words.roles) and not self._has(text, self.words.firms) else ("", text)

    def read(self, text: str | None) -> dict:
        out: dict = {"name": None, "summary": None, "experience": [], "education": [], "certificates": [], "languages": [], "projects": [], "skills": []}
        section, summary = "header", []
        self.open: dict | None = None
        for line in map(str.strip, (text or "").split("\n")):
            found = self.heading(line) if line else None
            if found:
                section, line = found
                self.open = None
            if not line:
                continue
            if section == "header":
                out["name"] = out["name"] or line
            elif section == "summary":
                summary.append(line)
            elif section != "ignored":
                getattr(self, section)(line, out[section])
        out["summary"] = " ".join(summary) or None
        return out

    @staticmethod
    def bullet(line: str) -> str | None:
        found = re.match(r"(?:[-•*►▪●–—+]\s*|[0-9]+\.\s+)(.*)", line)
        return found.group(1).strip() if found else None

    def experience(self, line: str, entries: list) -> None:
        """Bullets are highlights; a range of dates, or a role or firm behind bullets or beside a whole heading, opens the next entry."""
        entry, said = self.open, self.bullet(line)
        if said is not None and entry:
            if said:
                entry["highlights"].append(said)
            return
        dates = self.dates(line)
        named = (self._has(line, self.words.roles) or self._has(line, self.words.firms)) and not line[0].islower() and len(line) < 90
        begins = entry is None or (dates and entry["first"] is not None) or (named and (entry["highlights"] or (entry["role"] and entry["company"])))
        if begins:
            entry = self.open = dict.fromkeys(_PART) | {"highlights": [], "current": False}
            entries.append(entry)
        elif entry["highlights"] and not dates:
            entry["highlights"][-1] += " " + line  # a bullet goes on
            return
        rest = line
        if dates:
            entry.update(first=dates.first, last=dates.last, current=dates.current)
            rest = dates.rest
        if rest and (begins or named or dates):
            role, company = self.role_and_company(rest)
            entry["role"], entry["company"] = entry["role"] or role or None, entry["company"] or company or None
        elif rest:
            entry["description"] = f"{entry['description']} {rest}" if entry["description"] else rest

    def education(self, line: str, entries: list) -> None:
        """A line with dates opens an entry if the open one has some; parts are a degree or a school by their words."""
        dates = self.dates(line)
        rest = dates.rest if dates else line
        parts = [p.strip() for p in re.split(r"\s+[-–—]\s+|\s*[|·•]\s*|,\s*", rest) if p.strip()]
        schools = [p for p in parts if self._has(p, self.words.schools)]
        degrees = [p for p in parts if p not in schools]
        entry = self.open
        if entry is None or (dates and entry["first"] is not None) or (schools and entry["institution"]) or (degrees and entry["degree"] and not schools and not dates):
            entry = self.open = {"degree": None, "institution": None, "first": None, "last": None}
            entries.append(entry)
        if dates:
            entry.update(first=dates.first, last=dates.last)
        entry["institution"] = entry["institution"] or (schools[0] if schools else None)
        entry["degree"] = entry["degree"] or (", ".join(degrees) or None)

    def certificates(self, line: str, entries: list) -> None:
        """One a line: a name, behind a dash or comma its issuer, and a year."""
        line = self.bullet(line) or line
        date = self.single.search(folded(line)[0])
        year = month_of(date.group()) // 12 if date else None
        bare = (line[: date.start()] + line[date.end() :] if date else line).replace("()", "").strip(" ,;|()-–—")
        parts = [p.strip() for p in re.split(r"\s+[-–—]\s+|\s*\|\s*|,\s*", bare, maxsplit=1)]
        if parts[0]:
            entries.append({"name": parts[0], "issuer": parts[1] if len(parts) > 1 and parts[1] else None, "year": year})

    def languages(self, line: str, entries: list) -> None:
        """Parted by commas, semicolons and bars; a level stands behind a language."""
        for part in re.split(r"[,;|]", self.bullet(line) or line):
            words = re.findall(r"[^\s():–—-]+", part)
            level = next((w for w in words if folded(w)[0] in self.words.levels), None)
            name = " ".join(words[: words.index(level)] if level else words)
            if name:
                entries.append({"language": name, "level": level})

    def projects(self, line: str, entries: list) -> None:
        """A line opens a project: a name, tools in brackets, behind a dash what it is; bullets go to the open one."""
        said = self.bullet(line)
        if said is not None and self.open:
            self.open["description"] = f"{self.open['description']} {said}" if self.open["description"] else said
            return
        tools = re.search(r"\(([^()]*)\)", line)
        bare = line[: tools.start()] + line[tools.end() :] if tools else line
        name, _, what = re.sub(r"\s+[-–—:]\s+", "\x00", said or bare, count=1).partition("\x00")
        self.open = {"name": name.strip(" :"), "tools": [t.strip() for t in re.split("[,;/]", tools.group(1)) if t.strip()] if tools else [], "description": what.strip() or None}
        entries.append(self.open)

    def skills(self, line: str, entries: list) -> None:
        """Parted by commas, semicolons, bars and dots; each once, in any case of letters."""
        have = {folded(s)[0] for s in entries}
        for part in re.split(r"[,;|•·]", self.bullet(line) or line):
            part = part.strip(" .")
            if part and folded(part)[0] not in have:
                have.add(folded(part)[0])
                entries.append(part)


def parsed_profiles(docs: DataFrame, key: str, text: str, words: Words = Words()) -> DataFrame:  # noqa: B008
    """(key, name, summary, experience, education, certificates, languages, projects, skills) of plain texts.

    Months count from year 0; a current job has no last one.  A null or empty text has empty lists.  Texts are rows of
    their own; nothing is shuffled.
    """
    schema = T.StructType([docs.schema[key], *[T.StructField(n, T._parse_datatype_string(k)) for n, k in SCHEMA.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words)
        for batch in batches:
            rows = [reader.read(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *[pa.array([r[n] for r in rows], to_arrow_type(schema[n].dataType)) for n in SCHEMA]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
