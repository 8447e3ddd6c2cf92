"""Queries against their SQL on small tables that hold what the generated ones lack."""

from __future__ import annotations

import hashlib

import duckdb
import pandas as pd
from test_queries import table

from tallyroom.plans import catalogue


def agree(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(folder / f"{t}.parquet", index=False)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    cursor = con.execute(catalogue.oracle_sql()[name])
    columns, rows = [x[0] for x in cursor.description], df.collect()
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in rows]) == table(columns, cursor.fetchall())
    return rows


def documents(*texts):
    return pd.DataFrame({"doc_id": range(len(texts)), "text": texts})


def test_mentions_beside_signs(spark, tmp_path):
    rows = agree(spark, tmp_path, "requirement_mentions", documents=documents("Reti### is%%% than+", "reti2.5x than2 onder_ #leon", "in reti. Than++ the leon#", None))
    assert sorted((r.doc_id, r.phrase) for r in rows) == [(0, "reti"), (0, "than"), (1, "leon"), (1, "reti"), (1, "than"), (2, "leon"), (2, "reti"), (2, "than")]


def parts(*rows):
    return pd.DataFrame(rows, columns=["p_partkey", "p_type", "p_name"])


def test_claims_of_tags_are_told_in_order(spark, tmp_path):
    rows = agree(spark, tmp_path, "tag_claims", part=parts((10, "A", "a A"), (9, "A", "b"), (2, "B", "a"), (3, None, "a"), (4, "A", None)))
    assert {r.tag: r.claims for r in rows}["a"] == hashlib.md5(b"2,10").hexdigest()


def test_all_labels_of_a_skill(spark, tmp_path):
    rows = agree(spark, tmp_path, "skill_synonyms", part=parts(*[(i, "T", f"Ring {i:03}") for i in range(80)], (80, "T", "t"), (81, "T", "ring 001")))
    assert [(r.n, len(r.labels.split("|"))) for r in rows] == [(80, 80)]
