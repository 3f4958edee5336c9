"""Every query with an oracle gives DuckDB's rows over the smallest tables."""

import math
import re

import duckdb
import pytest

from lyrebird.plans import catalogue, collections, music, pictures, small  # noqa: F401
from lyrebird.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = [tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()]
    by = lambda r: tuple((v is not None, str(v)) for v in r)
    assert got and sorted(got, key=by) == sorted(want, key=by)


def test_rows_only_queries(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0


def test_related_catalogue_is_whole(spark):
    """All parts get what a comparison of each part with all others gives."""
    rows = sorted((r.p_partkey, f"{r.p_name}_{r.p_type}") for r in spark.read.parquet(f"{SF}/part.parquet").collect())
    tokens = {i: {w for w in re.split(r"[\s_-]+", name.lower()) if len(w) >= 2} for i, name in rows}
    ids, want = [i for i, _ in rows], []
    for at, i in enumerate(ids):
        out = [j for j in ids if j != i and tokens[i] & tokens[j]][:12]
        out += [j for j in ids[at + 1 :] + ids[:at] if j not in out][: 12 - len(out)]
        want += [(i, rank, j) for rank, j in enumerate(out, 1)]
    assert {r[0] for r in want} == set(ids)
    assert sorted(map(tuple, QUERIES["related_catalogue"](spark, SF).select("id", "rank", "other").collect())) == want


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
