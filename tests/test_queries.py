"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from spanloom.plans.oracles import ORACLES
from spanloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    rows, columns = [r.asDict() for r in found.collect()], sorted(found.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert columns == sorted(names)
    assert plain(rows, columns) == plain(expected, columns)


def test_citations_attribute_nothing(spark, monkeypatch):
    """Citations read no spans, so that replacing an attribution makes one and not two."""
    from spanloom.plans import queries

    made = []
    monkeypatch.setattr(queries, "attribute", lambda *args, of=queries.attribute, **named: made.append(1) or of(*args, **named))
    QUERIES["declared_citation"](spark, DATA)
    assert not made
    QUERIES["replace_attribution"](spark, DATA)
    assert made == [1]
