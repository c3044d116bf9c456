"""The corpus queries that SQL can express, against their SQL on the smallest given tables."""

from __future__ import annotations

import pytest

from check_oracle import compare, duck
from fidelscope.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    verdict, rows = compare(spark, duck(sf_dir), QUERIES[name], ORACLES[name], sf_dir)
    assert verdict == "equal" and rows > 0


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and not set(ORACLES) - set(QUERIES)
