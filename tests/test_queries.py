"""Every registered cohort query with SQL against DuckDB on the smallest tables."""

import pytest
from helpers import SF, same_rows

from ptclake.plans import source_queries  # noqa: F401  adds its queries
from ptclake.plans.feature_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name, tmp_path):
    """Every column is worked out, which a count would not ask for."""
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_cohort_scores_are_those_of_their_lines(spark, tmp_path):
    from ptclake.plans.shapes import lines

    QUERIES["cohort_scores"](spark, SF).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().set_index("id").sort_index()
    want = lines(spark, SF).selectExpr("id", "cast(l_quantity + l_tax * 500 > 40 AS int) AS label", "l_shipdate").toPandas().set_index("id").sort_index()
    assert got.index.equals(want.index) and got["label"].equals(want["label"]) and got["l_shipdate"].equals(want["l_shipdate"])
    assert ((got["escape_probability"] >= 0.5).astype(int) == got["predicted_class"]).all() and got["escape_probability"].between(0, 1).all()
    assert (got["predicted_class"] == got["label"]).mean() > 0.7


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
