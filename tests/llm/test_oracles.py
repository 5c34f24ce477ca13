"""Operators with a SQL form against it, on the smallest tables."""

import pytest

from compare import same
from tidewell.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name], FOLDER) >= 200
