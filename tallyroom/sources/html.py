"""Records from raw web pages, by a cascade: embedded JSON-LD, state that scripts hydrate from, the page's text, social tags."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.functions.text import url_domain
from tallyroom.sources.markup import Page

LEAST, MOST = 80, 20_000
#: A state's keys, lower-cased, by field; levels that are searched.
STATE_KEYS = {
    "title": ("jobtitle", "title", "positionname", "offername"),
    "company": ("companyname", "company", "employername", "hiringorganization"),
    "description": ("description", "jobdescription", "descriptiontext", "offerdescription"),
}
LD_DEPTH, STATE_DEPTH = 6, 8
_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "company", "description")])


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\u00A0]+", " "))


def plain(html: Column) -> Column:
    """Text without scripts, styles, comments, tags and the commonest entities; white space becomes one space."""
    out = F.regexp_replace(html, "(?is)" + "|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("script", "style", "noscript", "template")) + "|<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return collapsed(out)


def title_part(title: Column) -> Column:
    """Without what follows the last separator: a bar, a long dash or a middle dot, or a hyphen between spaces."""
    parts = F.filter(F.split(title, "\\s+[|–—·]\\s+|\\s+-\\s+"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), " - ")).otherwise(title)


def _strict(raw: str):
    """JSON, null where it is broken; NaN and its like are no JSON."""

    def no(name: str):
        raise ValueError(name)

    try:
        return json.loads(raw, parse_constant=no)
    except (ValueError, RecursionError):
        return None


def _find(node, kind: str, depth: int = 0):
    """The first node of a type: in lists, and under the keys that hold entries."""
    if depth > LD_DEPTH:
        return None
    below = node if isinstance(node, list) else []
    if isinstance(node, dict):
        types = node.get("@type")
        if types == kind or (isinstance(types, list) and kind in types):
            return node
        below = [node[k] for k in ("@graph", "mainEntity", "itemListElement") if k in node]
    return next((x for x in (_find(n, kind, depth + 1) for n in below) if x is not None), None)


def _said(value) -> str:
    return value.strip() if isinstance(value, str) else ""


def _posting(bodies: list[str], kind: str) -> dict | None:
    for body in bodies:
        node = _find(_strict(body), kind)
        if node is None:
            continue
        text = _said(node.get("description"))
        text = " ".join((entities.unescape(re.sub("<[^>]*>", "", text)) if "<" in text else text).split())
        if _said(node.get("title")) or text:
            employer = node.get("hiringOrganization")
            return {"title": _said(node.get("title")), "company": _said(employer.get("name")) if isinstance(employer, dict) else "", "description": text}
    return None


def _field(node: dict, keys: tuple[str, ...], depth: int = 0) -> str:
    if depth > STATE_DEPTH:
        return ""
    for key, value in node.items():
        if key.lower() in keys:
            if isinstance(value, dict) and isinstance(value.get("name"), str):
                return value["name"].strip()
            if _said(value):
                return _said(value)
    return next((x for x in (_field(v, keys, depth + 1) for v in node.values() if isinstance(v, dict)) if x), "")


def _assigned(bodies: list[str], name: str):
    """The JSON value that a script assigns to a name of the window; brackets within strings don't count."""
    for body in bodies:
        begin = re.search(rf"window\.{name}\s*=\s*(?=[{{\[])", body)
        if not begin:
            continue
        depth = 0
        for m in re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[{}\[\]]', re.S).finditer(body, begin.end()):
            depth += (m.group() in "{[") - (m.group() in "}]")
            if depth == 0 and m.group() in "}]":
                return _strict(body[begin.end() : m.end()])
    return None


def _state(heads: list[str], bodies: list[str]) -> dict | None:
    following = [b for h, b in zip(heads, bodies, strict=True) if re.search(r"id=[\"']__NEXT_DATA__[\"']", h)][:1]
    inline = [b for h, b in zip(heads, bodies, strict=True) if not re.search(r"\ssrc\s*=", h)]
    for root in (_strict(following[0]) if following else None, _assigned(inline, "__NUXT__"), _assigned(inline, "__INITIAL_STATE__")):
        found = {k: _field(root, keys) for k, keys in STATE_KEYS.items()} if isinstance(root, dict) else {}
        if any(found.values()):
            return found
    return None


_PAGE = T.StructType([T.StructField("ld", _RECORD), T.StructField("state", _RECORD), *[T.StructField(c, T.StringType()) for c in ("main", "h1", "title", "employer", "og_title", "og_text", "site")]])


def _meta(page: Page, *names: str) -> str | None:
    return next((page.metas[n] for n in names if n in page.metas), None)


@F.pandas_udf(_PAGE)
def read_page(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What a page holds: postings and states in its scripts, its main text, headings and social tags; one reading a page."""
    for batch in pages:
        rows = []
        for source in batch:
            page = Page(source or "")
            heads, bodies = [h for h, _ in page.scripts], [b for _, b in page.scripts]
            ld = [b for h, b in page.scripts if re.search(r"type=[\"']application/ld\+json[\"']", h)]
            rows.append((
                _posting(ld, "JobPosting"), _state(heads, bodies), page.main(LEAST, MOST), page.part("h1") or None, page.part("title") or None, page.employer(),
                _meta(page, "og:title", "twitter:title"), _meta(page, "og:description", "twitter:description", "description"), _meta(page, "og:site_name"),
            ))
        yield pd.DataFrame(rows, columns=_PAGE.names, dtype=object)


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The columns without the page, then domain, tier, title, company and description; empty ones are null.

    tier: json-ld where a posting has a title or a description, hydration where a state's description has 80 characters,
    main-content where the page's own text has, open-graph where a meta description is all there is, else none.  The
    description is the tier's, or the page's where that is shorter.  A null page has tier none and nulls.
    """
    rows = pages.withColumn("__p", read_page(html))
    rows = rows.withColumns({"__base": F.coalesce(F.col("__p.ld"), F.col("__p.state")), "__main": F.col("__p.main"), "__og": F.col("__p.og_text")})
    tier = F.when(F.col("__p.ld").isNotNull(), "json-ld").when(F.length("__p.state.description") >= LEAST, "hydration").when(F.col("__main").isNotNull(), "main-content").when(F.col("__og").isNotNull(), "open-graph").otherwise("none")
    own = F.when(F.length("__base.description") >= LEAST, F.col("__base.description"))
    first = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])
    out = rows.withColumns(
        {
            "domain": url_domain(F.col(url)), "tier": tier,
            "title": first(F.col("__base.title"), F.col("__p.h1"), title_part(F.col("__p.og_title")), title_part(F.col("__p.title"))),
            "company": first(F.col("__base.company"), F.col("__p.employer"), F.col("__p.site")),
            "description": F.coalesce(own, F.col("__main"), F.col("__og")),
        }
    )
    return out.drop(html, "__p", "__base", "__main", "__og")


def robots_rules(files: DataFrame, agent: str, host: str = "host", text: str = "text") -> DataFrame:
    """(host, pattern, allow) of robots files for an agent: those of the agent's name that is the longest part of it, else those of *.

    Lines of one agent after another share the rules that follow.  Rules of one name count together, wherever they stand;
    of names of one length the one whose first rule comes first counts.  Comments and empty bars are passed over, so a
    name that has no other rules is as if it were not there, and * counts.
    """
    lines = files.select(host, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    at = F.expr("instr(line, ':')")
    lines = lines.where(at > 0).select(host, "n", F.lower(F.trim(F.expr("left(line, instr(line, ':') - 1)"))).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    lines = lines.where("key IN ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy(host).orderBy("n")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("block", F.sum(begins.cast("int")).over(w))
    names = lines.where("key = 'user-agent'").select(host, "block", F.lower("value").alias("name")).distinct()
    rules = lines.where("key = 'allow' OR key = 'disallow' AND value <> ''").select(host, "block", "n", F.col("value").alias("pattern"), (F.col("key") == "allow").alias("allow"))
    fits = F.when(F.col("name") == "*", F.lit(-1)).when(F.lit(agent.lower()).contains(F.col("name")), F.length("name"))
    named = names.withColumn("fit", fits).where("fit IS NOT NULL").join(rules, [host, "block"])
    best = named.groupBy(host).agg(F.max_by("name", F.struct("fit", -F.col("n"))).alias("name"))
    return named.join(best, [host, "name"]).select(host, "pattern", "allow").distinct()


def robots(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, allowed) by rules (host, pattern, allow): the longest pattern that fits the path's beginning wins, allow on ties; none: allowed.

    In a pattern * is any run of characters, and $ at its end the path's end.  urls: (url, host, path).
    """
    quoted = F.regexp_replace("pattern", "([.+?^$(){}|\\[\\]\\\\])", "\\\\$1")
    form = F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), "\\\\\\$$", "\\$"))
    fit = urls.join(rules.withColumn("form", form), "host").where(F.expr("path RLIKE form"))
    best = fit.groupBy("url").agg(F.max(F.struct(F.length("pattern"), F.col("allow"))).alias("b"))
    return urls.join(best, "url", "left").select("url", F.coalesce(F.col("b.allow"), F.lit(True)).alias("allowed"))


def is_shell(html: Column, least: int = 250) -> Column:
    """A page that a script fills in: hardly any text in all, or in the element that it mounts on."""
    text = F.length(plain(html))
    mount = F.regexp_extract(html, "(?is)<[^>]*id=[\"'](?:root|app|__next|__nuxt|app-root)[\"'][^>]*>(.*?)</", 1)
    mounted = html.rlike("(?i)<[^>]*id=[\"'](?:root|app|__next|__nuxt|app-root)[\"']")
    return (html != "") & ((text < least) | (mounted & (F.length(plain(mount)) < least)))


def portal_of(url: Column, portals: list[tuple[str, str]]) -> Column:
    """The name of the first portal (domain, name) whose domain the url's host is, or lies under."""
    host, out = url_domain(url), F.lit(None).cast("string")
    for domain, name in reversed(portals):
        out = F.when((host == domain) | F.endswith(host, F.lit(f".{domain}")), F.lit(name)).otherwise(out)
    return out
