"""Every registered query agrees with its SQL partner at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import compare, connect  # noqa: E402
from conftest import SF  # noqa: E402

import __spark_entry__ as driver  # noqa: E402
from workload.oracles import ORACLES  # noqa: E402
from workload.queries import REGISTERED  # noqa: E402


@pytest.fixture(scope="module")
def tables():
    con = connect(SF)
    yield con
    con.close()


def test_every_query_has_a_partner():
    assert set(REGISTERED) == set(ORACLES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_agrees(spark, tables, name):
    assert compare(spark, tables, SF, name) is None
