"""Graphs as vertex and edge tables: ranks, bounded paths, audits, tiered search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.numbers import round_half_up
from tallyroom.functions.phrases import substituted
from tallyroom.functions.text import stem_phrase
from tallyroom.operators.tables import saved, stated_list


def degrees(vertices: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(node, n_in, n_out, n_all) of every vertex; rejected edges (status) don't count."""
    ends = edges.where(F.coalesce(F.col("status"), F.lit("")) != "rejected").select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    n = ends.groupBy(F.col("e.v").alias(node)).agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))
    out = vertices.select(node).join(n, node, "left").fillna(0, ["n_in", "n_out"])
    return out.withColumn("n_all", F.col("n_in") + F.col("n_out"))


def pagerank(vertices: DataFrame, edges: DataFrame, *, node: str = "id", damping: float = 0.85, rounds: int = 50, save_every: int = 10, save: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """(node, rank) after a fixed number of rounds; parallel edges count each, the mass of dead ends is spread evenly.

    Edges are grouped once, with their multiplicity; a round is one join on the source and one sum by target.  Every
    ``save_every`` rounds the ranks are written, which cuts the lineage.
    """
    links = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    out = links.groupBy("src").agg(F.sum("m").alias("out"))
    links = save(links.join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("share")))
    nodes = vertices.select(F.col(node).alias("id")).distinct().join(out.select(F.col("src").alias("id"), F.lit(False).alias("dead")), "id", "left").fillna(True, ["dead"])
    nodes = save(nodes)
    n = F.lit(nodes.count()).cast("double")
    ranks = nodes.withColumn("rank", 1 / n)
    for i in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("dead"), F.col("rank")).otherwise(0.0))).scalar()
        got = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        ranks = nodes.join(got, "id", "left").select("id", "dead", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + lost / n)).alias("rank"))
        if (i + 1) % save_every == 0 or i + 1 == rounds:
            ranks = save(ranks)
    return ranks.select(F.col("id").alias(node), "rank")


def path_costs(edges: DataFrame, factors: dict[str, float] | None = None, least: float | None = None, types: list[str] | None = None) -> DataFrame:
    """(src, dst, cost, sure) both ways: cost 1 / (weight * confidence * factor of the type), weight and confidence at least 0.1.

    least, types: edges of less confidence, or of other types, are no way; a null confidence is less than any.
    """
    edges = edges if least is None else edges.where(F.col("confidence") >= least)
    edges = edges if types is None else edges.where(F.col("type").isin(*types))
    factor = F.lit(1.0)
    for kind, f in (factors or {}).items():
        factor = F.when(F.col("type") == kind, F.lit(f)).otherwise(factor)
    w, c = F.greatest(F.lit(0.1), F.col("weight")), F.greatest(F.lit(0.1), F.col("confidence"))
    one = edges.select("src", "dst", (1 / (w * c * factor)).alias("cost"), (F.col("confidence") * F.col("weight")).alias("sure"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "sure")).where("src <> dst")
    # of parallel edges the cheapest
    return both.groupBy("src", "dst").agg(F.min("cost").alias("cost"), F.max_by("sure", -F.col("cost")).alias("sure"))


def bounded_paths(sources: DataFrame, costs: DataFrame, most: int = 4, exclude: DataFrame | None = None) -> DataFrame:
    """(source, node, cost, hops, path, sure): the cheapest way of at most ``most`` edges to every node within reach.

    Each round relaxes from every way of exactly so many edges and keeps the cheapest of them by node, so the result is
    the true bounded optimum; of equal costs the smaller path counts.  sources: (source).  sure: the product of the edges'
    confidence and weight.  exclude: nodes (its first column) that no way enters.
    """
    if exclude is not None:
        costs = costs.join(exclude.select(F.col(exclude.columns[0]).alias("dst")).distinct(), "dst", "left_anti")
    front = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.array("source").alias("path"), F.lit(1.0).alias("sure"))
    found = front.withColumn("hops", F.lit(0))
    for hop in range(1, most + 1):
        steps = front.join(costs.select(F.col("src").alias("node"), F.col("dst"), F.col("cost").alias("c"), F.col("sure").alias("u")), "node")
        front = steps.select("source", F.col("dst").alias("node"), round_half_up(F.col("cost") + F.col("c"), 8).alias("cost"), F.concat("path", F.array("dst")).alias("path"), (F.col("sure") * F.col("u")).alias("sure"))
        front = front.groupBy("source", "node").agg(F.min(F.struct("cost", "path", "sure")).alias("b")).select("source", "node", "b.cost", "b.path", "b.sure")
        found = found.unionByName(front.withColumn("hops", F.lit(hop)))
    best = found.groupBy("source", "node").agg(F.min(F.struct("cost", "hops", "path", "sure")).alias("b"))
    return best.where("node <> source").select("source", "node", "b.cost", "b.hops", "b.path", "b.sure")


def audit(vertices: DataFrame, edges: DataFrame, node_floor: float = 0.4, edge_floor: float = 0.3) -> DataFrame:
    """(kind, id, detail): weak vertices and edges, names that several vertices share, vertices without an edge, ends that don't exist."""
    weak_v = vertices.where(F.col("confidence") < node_floor).select(F.lit("LOW_CONFIDENCE_VERTEX").alias("kind"), F.col("id").cast("string").alias("id"), F.col("name").alias("detail"))
    weak_e = edges.where(F.col("confidence") < edge_floor).select(F.lit("LOW_CONFIDENCE_EDGE"), F.col("id").cast("string"), F.col("type"))
    names = vertices.groupBy(F.lower("name").alias("n")).agg(F.count("*").alias("k"), F.min("id").alias("i")).where("k > 1").select(F.lit("DUPLICATE_NAME"), F.col("i").cast("string"), F.col("n"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    orphans = vertices.join(ends, "id", "left_anti").select(F.lit("ORPHAN"), F.col("id").cast("string"), F.col("name"))
    dangling = ends.join(vertices, "id", "left_anti").select(F.lit("DANGLING"), F.col("id").cast("string"), F.lit(None).cast("string"))
    return weak_v.union(weak_e).union(names).union(orphans).union(dangling)


def tiered_search(queries: DataFrame, names: DataFrame, similarity: Callable[[Column, Column], Column], least: float = 0.52, jargon: dict[str, str] | None = None, actors: dict[str, list[str]] | None = None) -> DataFrame:
    """(query, id, score, tier): exact names 1, aliases 0.96, jargon 0.94, actors 0.92, stems 0.91, tags 0.82, else alike ones.

    names: id, name, confidence, aliases, tags (arrays).  jargon: what a query's words stand for; actors: who does what a
    word within a query names.  Each tier but the last is an equi-join of the query's forms with the names'; the last is
    0.75 * likeness + 0.25 * confidence of the likest of name and aliases, and the stated list of queries is sent to all
    names, so every pair is compared.  A pair counts by its first tier.
    """
    q = queries.select("query", F.lower("query").alias("q"))
    form = lambda kind, of: F.transform(of, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t")))
    said = F.flatten(F.array(*[F.when(F.col("q").contains(w), F.array(*[F.lit(a) for a in found])).otherwise(F.array().cast("array<string>")) for w, found in (actors or {"": []}).items() if w])) if actors else F.array().cast("array<string>")
    asked = q.select("query", F.explode(F.concat(form("plain", F.array("q")), form("jargon", F.array(substituted(F.col("q"), jargon or {}))), form("actor", said), form("stem", F.array(stem_phrase(F.col("q")))))).alias("x")).select("query", "x.*")

    def tier(column: Column, score: float, name: str, kind: str) -> Column:
        return F.transform(column, lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(t).alias("t"), F.lit(score).alias("s"), F.lit(name).alias("tier")))

    called, low = F.array("name"), F.transform(F.array("name"), lambda t: F.lower(t))
    tiers = F.concat(
        tier(called, 1.0, "exact", "plain"), tier(F.col("aliases"), 0.96, "alias", "plain"), tier(called, 0.94, "jargon", "jargon"), tier(called, 0.92, "verbal", "actor"),
        tier(F.transform(low, lambda t: stem_phrase(t)), 0.91, "stem", "stem"), tier(F.col("tags"), 0.82, "tag", "plain"),
    )
    terms = names.select("id", F.explode(tiers).alias("x")).select("id", "x.*")
    sure = asked.join(terms, ["kind", "t"]).select("query", "id", "s", "tier")
    texts = F.concat(F.array("name"), F.coalesce(F.col("aliases"), F.expr("CAST(array() AS array<string>)")))
    alike = names.select("id", "confidence", F.explode(texts).alias("n")).withColumn("n", F.lower("n"))
    # every pair of a stated list and the names; the list is sent where its size is checked, else dealt in blocks
    pairs = alike.join(stated_list(q))
    like = pairs.withColumn("l", similarity(F.col("q"), F.col("n"))).where(F.col("l") >= least).groupBy("query", "id").agg(F.max(0.75 * F.col("l") + 0.25 * F.col("confidence")).alias("s")).withColumn("tier", F.lit("fuzzy"))
    order = F.array(*[F.lit(t) for t in ("exact", "alias", "jargon", "verbal", "stem", "tag", "fuzzy")])
    ranked = sure.unionByName(like).withColumn("o", F.array_position(order, F.col("tier")))
    best = ranked.groupBy("query", "id").agg(F.min_by(F.struct("s", "tier"), "o").alias("b"))
    return best.select("query", "id", F.col("b.s").alias("score"), F.col("b.tier").alias("tier"))


def path_steps(paths: DataFrame, costs: DataFrame) -> DataFrame:
    """(source, node, step, src, dst, cost, sure): each edge of each path (source, node, path), and what it costs, two decimals."""
    rows = paths.select("source", "node", "path", F.posexplode(F.slice("path", F.lit(2), F.size("path"))).alias("i", "dst"))
    rows = rows.select("source", "node", (F.col("i") + 1).alias("step"), F.col("path")[F.col("i")].alias("src"), "dst")
    return rows.join(costs.select("src", "dst", round_half_up(F.col("cost"), 2).alias("cost"), "sure"), ["src", "dst"]).select("source", "node", "step", "src", "dst", "cost", "sure")
