import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lyrebird.llm import queries
from tests.llm.test_groups import clusters


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    x = clusters(np.random.default_rng(12), 240, 16)
    folder = tmp_path_factory.mktemp("planted")
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x) + 2), pa.int64()), "embedding": pa.array([*x.tolist(), None, [0.0] * 16], pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, planted, sf, name):
    c = duckdb.connect()
    if name in ("op5_embeddings", "op9_topk"):
        c.execute(f"create view embeddings as select * from read_parquet('{planted}/embeddings.parquet')")
    else:
        for t in ("documents", "conversations"):
            c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
        planted = sf
    want = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = sorted(want.fetchall())
    got = queries.queries()[name](spark, planted)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[k] for k in columns) for r in got.collect()) == rows
    assert rows
    if name == "op5_embeddings":
        assert sum(r[columns.index("n_links")] for r in rows) > 50


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
