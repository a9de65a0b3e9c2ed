"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from sonolog.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = queries()[name](spark, sf_dir).toPandas()
    verdict = compare(got, con.execute(oracle_sql()[name]).fetchdf())
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 20
    assert rows[0]["minutes"] >= rows[-1]["minutes"]


@pytest.mark.parametrize(
    "name", ["clean_plays", "canonical_plays", "repeat_gaps", "json_history_ingest", "stream_daily_minutes", "heatmap_dense"]
)
def test_results_do_not_depend_on_zone_or_ansi(spark, con, sf_dir, name):
    settings = {"spark.sql.session.timeZone": "America/New_York", "spark.sql.ansi.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = queries()[name](spark, sf_dir).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    verdict = compare(got, con.execute(oracle_sql()[name]).fetchdf())
    assert verdict.startswith("ok"), verdict
