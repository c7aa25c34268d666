"""Every query of the trace operators gives what its SQL gives."""

import json

import pytest

import __spark_entry__ as entry
from spanloom.plans import registry

NAMES = sorted(registry.queries())


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if v is not None and not isinstance(v, (int, float, bool, str)) else v


def rows(names, table):
    return sorted(json.dumps([plain(v) for _, v in sorted(zip(names, r))]) for r in table)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = df.collect()
    if name in registry.oracle_sql():
        cur = duck.execute(registry.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, cur.fetchall())
    else:
        assert df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
