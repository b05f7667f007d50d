import os

import pytest
from check_queries import compare, connect, entry_module

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

if not os.path.isdir(FOLDER):
    pytest.skip("driver tables not present", allow_module_level=True)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, con, name):
    verdict, count, _, _ = compare(spark, con, FOLDER, name)
    assert verdict in ("ok", "rows only") and count >= 0


def test_entry(spark):
    assert {"query_id", "db_id", "score", "evalue"} <= set(entry_module.entry(spark).columns)
