"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from mnemoweave import queries as core


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(name, spark, data, duck):
    df = core.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(name, spark, data):
    assert core.queries()[name](spark, data).count() > 0


def test_entry_points(spark):
    assert entry.entry(spark).columns
    assert set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
