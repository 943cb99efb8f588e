"""Every query against its SQL on the smallest given tables."""

import importlib.util
import pathlib

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("check_oracles", ROOT / "tools" / "check_oracles.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(check.driver.queries()))
def test_query_equals_sql(spark, con, name):
    frame = check.driver.queries()[name](spark, FOLDER).toPandas()
    sql = check.driver.oracle_sql().get(name)
    if sql is not None:
        assert check.compare(frame, con.execute(sql).fetch_df()) is None


def test_entry(spark):
    assert check.driver.entry(spark).count() > 0
