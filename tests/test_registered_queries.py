"""Every registered core query against its SQL on the smallest data; queries without SQL must run."""

import pytest
from oracle import database, rows_of, rows_of_sql

from strataloom.plans import registry


@pytest.fixture(scope="module")
def db(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, small, db, name):
    assert rows_of(registry.queries()[name](spark, small)) == rows_of_sql(db, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_messages_with_tabs_are_parsed(spark, tmp_path):
    f = "struct<path:string,insertions:int,deletions:int>"
    rows = [("a", "r", "me", "2026-01-01", "fix\n\nbody\n3\t1\tsrc/x\ty.ts\nx\ty\n", [("b.ts", 1, None)]), ("b", "r", "you", None, "\ttab first", []), ("c", "r", "you", "", None, None), ("d", "r", "you", "", "  plain  ", [("c.ts", 5, 6)])]
    spark.createDataFrame(rows, f"short_hash string, repo string, author string, date string, message string, files array<{f}>").coalesce(1).write.parquet(str(tmp_path / "commits.parquet"))
    c = database(str(tmp_path / "none") if (tmp_path / "none").mkdir() else str(tmp_path / "none"))
    c.sql(f"CREATE VIEW commits AS SELECT * FROM '{tmp_path}/commits.parquet/*.parquet'")
    got = rows_of(registry.queries()["git_log_parse"](spark, str(tmp_path)))
    assert got == rows_of_sql(c, registry.oracle_sql()["git_log_parse"])
    assert {("fix\n\nbody", 2, 4, 1), ("", 0, 0, 0), ("plain", 1, 5, 6)} <= {(r["message"], r["n_files"], r["added"], r["removed"]) for r in registry.queries()["git_log_parse"](spark, str(tmp_path)).collect()}
