"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connection
from vigilseq.plans import catalog, logs, reports

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not found")
SQL = entry.oracle_sql()
OWN = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) >= set(OWN) and set(entry.queries()) >= set(OWN)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    same, note = compare(spark, con, FOLDER, name, entry.queries()[name], SQL.get(name))
    assert same, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_report_tables_follow_the_data(spark, tmp_path):
    """A stored table is not read any more once the log's files have changed."""
    folder = str(tmp_path)
    log = spark.read.parquet(f"{FOLDER}/events.parquet")
    log.limit(300).write.parquet(f"{folder}/events.parquet")
    before = reports.topk_table(spark, folder).count()
    assert reports.topk_table(spark, folder).count() == before
    log.limit(900).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    assert reports.topk_table(spark, folder).count() > before


def test_times_do_not_depend_on_the_session_zone(spark):
    def days(zone):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = logs.day_log(spark, FOLDER).selectExpr("session_id", "unix_micros(ts) t").collect()
            assert spark.conf.get("spark.sql.session.timeZone") == zone
            return sorted(map(tuple, rows))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    assert days("America/Sao_Paulo") == days("UTC")
