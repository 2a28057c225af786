"""The training-data queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from klangsieb.llm.queries import QUERIES
from klangsieb.llm.sql import SQL
from tests.test_catalog import compare, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    compare(spark, duck, name)


def test_found_queries_are_complete():
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 7, 8, 9)} <= SQL.keys() <= QUERIES.keys()


def test_splits_reach_their_targets(spark):
    rows = QUERIES["p5_splits"](spark, "/root/testdata/sf0.01").groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in rows}
    total = sum(n.values())
    assert all(abs(n[s] / total - share) < 0.01 for s, share in {"train": 0.9, "val": 0.05, "test": 0.05}.items()), n


def test_little_room_is_left(spark):
    u = QUERIES["p7_room"](spark, "/root/testdata/sf0.01").first()
    assert u["fullest"] <= 8192 and u["containers"] <= u["least"] + 1
