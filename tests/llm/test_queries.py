"""Registered queries and pipeline stages, against SQL where there is some."""

import duckdb
import pytest

import corpus_pipeline
from inkveil.llm.queries import registered, statements
from tests.llm.edge import empty, frame

QUERIES, SQL = registered(), statements()


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(name, spark, sf_dir):
    db = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), db.sql(SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_keep_the_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60), frame(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, sf_dir)
            if name != "packing":
                assert done.columns == docs.columns, name
            done.write.format("noop").mode("overwrite").save()


def test_pipeline(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(sizes.values()) <= 1024
