"""Every registered query of the query book against DuckDB at the smallest scale."""

import os

import pytest

from pyspark.sql import functions as F

from emberline.session import remove_staged
from querybook import queries, streams  # noqa: F401  (streams registers the streaming queries)
from querybook import tables as given
from querybook.queries import BOOK
from tests.check_oracle import compare, oracle

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return oracle(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def shared_inputs(spark):
    """What many queries derive from the tables alike is made once for this module."""
    shared = [(given, "log_events"), (given, "anomalies"), (given, "summarised_anomalies")]
    shared += [(queries, "_outcome"), (queries, "_cards"), (queries, "_views")]
    with pytest.MonkeyPatch.context() as patch:
        for module, name in shared:

            def once(session, sf_dir, make=getattr(module, name), made={}):
                if sf_dir not in made:
                    made[sf_dir] = make(session, sf_dir)
                return made[sf_dir]

            patch.setattr(module, name, once)
        yield
    remove_staged(spark)


@pytest.mark.parametrize("name", sorted(BOOK))
def test_query_matches_sql(spark, connection, name):
    query, sql = BOOK[name]
    assert compare(spark, connection, name, query, sql, SF_DIR) is None


def test_jobs_are_all_orders_with_lines(spark):
    orders = given.table(spark, SF_DIR, "orders").select("o_orderkey").distinct()
    lines = given.table(spark, SF_DIR, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    assert given.jobs(spark, SF_DIR).count() == orders.join(lines, "o_orderkey").count()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert "fingerprint" in frame.columns and frame.count() > 0
