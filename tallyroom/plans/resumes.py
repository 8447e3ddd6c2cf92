"""Queries over profiles that are plain texts; the texts are made of customers and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators import resume
from tallyroom.plans.registry import query
from tallyroom.sources.tables import read


def _texts(spark, d) -> DataFrame:
    """A profile for each customer with orders: jobs in three forms by the order's key, a line for each section."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    date, end = F.to_date("o_orderdate"), F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 7).cast("int"))
    role, firm = F.concat(F.lit("Operator "), F.col("o_orderpriority")), F.concat(F.lit("Firma "), k.cast("string"))
    one = F.concat(role, F.lit(" | "), firm, F.lit(" ("), F.date_format(date, "MM.yyyy"), F.lit(" - "), F.date_format(end, "MM.yyyy"), F.lit(")"))
    two = F.concat(firm, F.lit(" - "), role, F.lit("\n"), F.date_format(date, "yyyy-MM"), F.lit(" – present"))
    three = F.concat(F.date_format(date, "MM/yyyy"), F.lit(" to "), F.date_format(end, "yyyy"), F.lit("\n"), role, F.lit(" at "), firm, F.lit("\nDaily work."))
    bullets = F.concat(F.lit("\n- price "), F.col("o_totalprice").cast("long").cast("string"), F.lit("\n• status "), F.col("o_orderstatus"), F.lit("\nand more"))
    job = F.concat(F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise(three), F.when(k % 2 == 0, bullets).otherwise(""))
    jobs = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", job.alias("j")))), lambda x: x["j"]), "\n").alias("jobs"))
    c = read(spark, d, "customer").join(jobs, "c_custkey")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = say(
        F.col("c_name"), "\nSomeone\n\n# Summary\nOf ", F.col("c_mktsegment"), ".\n1. WORK EXPERIENCE:\n", F.col("jobs"), "\nGDPR\nI agree.\nEducation\nBachelor ", F.col("c_mktsegment"), ", University of ", F.col("c_nationkey").cast("string"), " (2001 - 2005)\nCertificates\n- ISO ",
        F.col("c_nationkey").cast("string"), ", Office (", (F.col("c_custkey") % 20 + 2000).cast("string"), ")\nLanguages: Nation", F.col("c_nationkey").cast("string"), " - B2, Polish (native)\nProjects\nHouse (wood; stone) - of ", F.col("c_mktsegment"), "\n- tall\nSkills\n",
        F.lower("c_mktsegment"), ", ", F.col("c_mktsegment"), "; driving |",
    )
    return c.select("c_custkey", text.alias("text"))


@query("""
WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, CAST(o_orderkey % 7 AS INTEGER) AS n, o_orderpriority, o_totalprice, o_orderstatus FROM orders)
SELECT c_custkey, place, 'Operator ' || o_orderpriority AS role, 'Firma ' || o_orderkey AS company, CAST(m AS INTEGER) AS first, CAST(CASE o_orderkey % 3 WHEN 0 THEN m + n WHEN 2 THEN (m + n) // 12 * 12 END AS INTEGER) AS last, o_orderkey % 3 = 1 AS current, CASE WHEN o_orderkey % 3 = 2 THEN 'Daily work.' END AS description,
  CASE WHEN o_orderkey % 2 = 0 THEN 'price ' || CAST(trunc(o_totalprice) AS BIGINT) || '|status ' || o_orderstatus || ' and more' ELSE '' END AS highlights FROM o JOIN customer USING (c_custkey)
""")
def profile_jobs(spark, d) -> DataFrame:
    """Jobs of profiles, in order."""
    rows = resume.parsed_profiles(_texts(spark, d), "c_custkey", "text").select("c_custkey", F.posexplode("experience").alias("place", "e"))
    return rows.select("c_custkey", "place", "e.role", "e.company", "e.first", "e.last", "e.current", "e.description", F.array_join("e.highlights", "|").alias("highlights"))


@query("""
SELECT c_custkey, c_name AS name, 'Of ' || c_mktsegment || '.' AS summary, 'Bachelor ' || c_mktsegment || '/University of ' || c_nationkey || '/24012/24060' AS education, 'ISO ' || c_nationkey || '/Office/' || (2000 + c_custkey % 20) AS certificates, 'Nation' || c_nationkey || ':B2|Polish:native' AS languages,
  'House/wood+stone/of ' || c_mktsegment || ' tall' AS projects, lower(c_mktsegment) || '|driving' AS skills FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
""")
def profile_parts(spark, d) -> DataFrame:
    """The other sections of profiles, each in one line."""
    p = resume.parsed_profiles(_texts(spark, d), "c_custkey", "text")
    each = lambda c, body: F.array_join(F.transform(c, body), "|").alias(c)
    return p.select(
        "c_custkey", "name", "summary", each("education", lambda e: F.concat_ws("/", e["degree"], e["institution"], e["first"], e["last"])), each("certificates", lambda e: F.concat_ws("/", e["name"], e["issuer"], e["year"])),
        each("languages", lambda e: F.concat_ws(":", e["language"], e["level"])), each("projects", lambda e: F.concat_ws("/", e["name"], F.array_join(e["tools"], "+"), e["description"])), F.array_join("skills", "|").alias("skills"),
    )
