import __spark_entry__ as entry
from tests.oracle import assert_same


def test_pricing_summary(spark, data):
    assert_same(entry.queries()["pricing_summary"](spark, data), data, entry.oracle_sql()["pricing_summary"])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_each_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
