"""Every named query with a SQL twin equals it; the others run and keep a stable schema."""

import os

import pytest
from oracle import compare, connect

# A thousand epochs of a job each, whatever the number of points; test_layout runs fewer over several parts.
SLOW = {"r09_tsne_layout", "r10_reduce_all", "r10_layout_quality"}


def test_every_query(spark, sf_dir):
    from semdrift.plans.catalog import load

    queries, oracles = load()
    assert set(oracles) <= set(queries)
    con = connect(sf_dir)
    problems = {}
    for key in sorted(queries):
        if key in SLOW and not os.environ.get("TEST_ALL"):
            continue
        problem, _ = compare(spark, con, sf_dir, queries[key], oracles.get(key))
        if problem:
            problems[key] = problem
    assert not problems


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["from_year"] for r in rows] == list(range(1994, 2025))
    assert all(0 <= r["drift"] <= 2 for r in rows)


@pytest.mark.parametrize("family", "s t m h e g r c a v x p z".split())
def test_every_family_is_registered(spark, family):
    from semdrift.plans.catalog import load

    assert any(key.startswith(family) for key in load()[0])
