import __spark_entry__
import pytest
from helpers import FOLDER, connect, difference, folder_tables

from eventbook.llm.catalog import ORACLES, QUERIES


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql(spark, name):
    con = connect(**folder_tables(spark, "documents", "pages", "benchmark", "conversations"))
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
