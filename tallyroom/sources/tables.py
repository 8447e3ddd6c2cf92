"""Tables of a folder, and files of records with bad lines set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.functions.text import fold
from tallyroom.operators.tables import saved


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_records(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", line_breaks: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) of a JSON-lines or CSV file: a record that doesn't fit the schema is kept as it stands.

    Extra fields of JSON are passed over; an empty file gives no rows of either.  A CSV file's first line names the
    columns; a quoted field may hold commas and doubled quotes, and line breaks if asked: then a file is one task, else
    its parts are read by many.
    """
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if kind == "csv":
        parsed = saved(spark.read.csv(path, schema=whole, header=True, multiLine=line_breaks, escape='"', **options))
        return parsed.where("_corrupt IS NULL").drop("_corrupt"), parsed.where("_corrupt IS NOT NULL").select(F.col("_corrupt").alias("line"))
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select("value", F.from_json("value", whole, options).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*").drop("_corrupt"), rows.where(bad).select(F.col("value").alias("line"))


def read_seeds(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of JSON documents {"name", "skills": [...], "tools": [...]}, one a line, or with ``whole`` a file that is one of them or a list.

    Entities: (kind, name), each once; relations: (source, type, target).  A document without a name is passed over.
    """
    part = T.ArrayType(T.StringType())
    docs = spark.read.json(path, schema=T.StructType([T.StructField("name", T.StringType()), T.StructField("skills", part), T.StructField("tools", part)]), multiLine=whole).where("trim(name) <> ''")
    near = lambda kind, edge, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(edge).alias("type"), x.alias("target")))
    rows = docs.select("name", F.explode(F.concat(near("skill", "requires_skill", F.col("skills")), near("tool", "used_by", F.col("tools")))).alias("x")).select("name", "x.*")
    entities = docs.select(F.lit("profession").alias("kind"), "name").union(rows.select("kind", F.col("target").alias("name"))).distinct()
    return entities, rows.select(F.col("name").alias("source"), "type", "target").distinct()


def upserted(existing: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row a key, the one of the largest version; of equal ones the changed row.  What is written back is this whole."""
    columns = [c for c in existing.columns if c not in key]
    both = existing.withColumn("__side", F.lit(0)).unionByName(changes.select(*existing.columns).withColumn("__side", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(version, "__side")).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in columns]).select(*existing.columns)


def validate(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): rules are names and SQL conditions; quarantined rows carry the names they break.

    A condition that is null is broken.
    """
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken_rules", broken)
    return marked.where("size(broken_rules) = 0").drop("broken_rules"), marked.where("size(broken_rules) > 0")


def read_lexicon(spark: SparkSession, path: str, tags: list[str], longest: int = 64) -> DataFrame:
    """(form, lemma, tag, ord) of a tab-separated lexicon: lines of three fields or more, known tags, no spaces.

    Of lines with one form, the one whose tag stands first in ``tags`` stays, the first by lemma on ties.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 3")
    rows = lines.select(F.lower(F.col("f")[0]).alias("form"), F.lower(F.col("f")[1]).alias("lemma"), F.split(F.col("f")[2], ":")[0].alias("tag"))
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    rows = rows.where((rank > 0) & (F.length("form") <= longest) & ~F.col("form").contains(" ") & (F.col("form") != ""))
    return rows.groupBy("form").agg(F.min_by(F.struct("lemma", "tag"), F.struct(rank, "lemma")).alias("x")).select("form", "x.*", fold(F.col("form")).alias("folded"))


def json_ld(df: DataFrame, columns: dict[str, str], kind: str) -> DataFrame:
    """One JSON document a row, nulls left out; columns: key to column."""
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[F.col(c).alias(k) for k, c in columns.items()])
    return df.withColumn("json_ld", F.to_json(body))
