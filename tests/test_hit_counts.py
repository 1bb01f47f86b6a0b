"""Counts of offered rules where more than ten are mandatory."""

import duckdb

from docaudit.plans import registry


def test_more_mandatory_rules_than_places(spark, tmp_path):
    spark.range(200).selectExpr("id AS item_id", "concat('text ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(7).selectExpr("id AS conv_id", "cast(id % 3 AS int) AS turn", "'some words' AS text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    for t in ("benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(c.sql(registry.oracle_sql()["rule_hit_counts"]).fetchall())
    assert {r["rule"]: r["n"] for r in registry.queries()["rule_hit_counts"](spark, str(tmp_path)).collect()} == want
    assert len(want) == 10 and set(want.values()) == {7}
    # what retrieval returns still holds all twelve
    every = registry.queries()["select_top_k"](spark, str(tmp_path)).collect()
    assert sorted((r["chunk"], r["rule"], r["rank"]) for r in every) == sorted(c.sql(registry.oracle_sql()["select_top_k"]).fetchall()) and len(every) == 84
