"""The registered queries against their SQL twins."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of

SOME = (
    "confidence_flags", "status_counts", "consensus_by_fingerprint", "library_stats", "memory_stats",
    "report_similarity", "latest_activity", "ranked_artifacts", "training_comments", "merged_reports",
    "near_matches", "recorded_events",
)


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {n for n in queries if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert len(own) >= 90
    assert own - set(oracles) == {"memory_matches", "edit_distance_levels"}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["checker", "approved", "rejected", "needs_change", "open"] and df.count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
