"""Sweeps, chains and what is built on them, against plain loops; hot keys go over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.operators import sweeps
from lyrebird.streaming import rooms


@pytest.fixture
def wide(spark):
    """More partitions than usual, so that keys go over several."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("backward", [False, True])
def test_following(wide, backward):
    rng = np.random.default_rng(int(backward))
    rows = [("hot" if k < 600 else None if k < 640 else f"k{k % 7}", k, int(v) if v < 2**60 and rng.random() < 0.02 + 0.3 * (k > 560) else None) for k, v in enumerate(rng.integers(0, 2**61, 800))]
    df = wide.createDataFrame(rows, "k string, i long, v long").repartition(4)
    got = {(r.k, r.i): r.found for r in sweeps.following(df, ["k"], ["i"], F.col("v"), "found", backward).collect()}
    want = {}
    for k, i, _ in rows:
        later = [r for r in rows if r[0] == k and (r[1] < i if backward else r[1] > i) and r[2] is not None]
        want[k, i] = (later[-1] if backward else later[0])[2] if later else None
    assert got == want and sweeps.following(df.limit(0), ["k"], ["i"], F.col("v"), "found").collect() == []


def test_chain(wide):
    rng = np.random.default_rng(4)
    rows = [(k, p, p + int(s) if p + s < n else None) for k, n in ((1, 700), (2, 1), (3, 40), (4, 200)) for p, s in enumerate(rng.integers(1, 6 if k != 4 else 2, n))]
    got = {tuple(r) for r in sweeps.chain(wide.createDataFrame(rows, "k long, p long, n long").repartition(5), "k", "p", "n").collect()}
    step, want = {(k, p): n for k, p, n in rows}, set()
    for k in (1, 2, 3, 4):
        p = 0
        while p is not None:
            want.add((k, p))
            p = step[k, p]
    assert got == want
    assert sweeps.chain(wide.createDataFrame([], "k long, p long, n long"), "k", "p", "n").collect() == []


def test_a_hot_room_is_owned_as_by_a_plain_fold(wide):
    rng = np.random.default_rng(7)
    rows = [(9 if k % 3 else int(rng.integers(0, 4)), k, str(rng.choice(["claim", "claim", "release", "disconnect"])), f"c{rng.integers(0, 5)}" if k % 50 else None, "x") for k in range(900)]
    df = wide.createDataFrame([*rows, (None, 1, "claim", "a", "y")], "room long, seq long, op string, client string, owned string").repartition(4)
    owner, want = {}, {}
    for room, seq, op, client, _ in rows:
        owner[room] = rooms._next_owner(owner.get(room), op, client)
        want[room, seq] = owner[room]
    got = rooms.ownership(df).collect()
    assert {(r.room, r.seq): r.owner for r in got} == want and len(got) == len(rows) and {r.owned for r in got} == {"x"}


def test_throttle_opens_with_the_first_event(wide):
    rng = np.random.default_rng(8)
    times = np.cumsum(rng.integers(0, 300_000, 700)).tolist()
    rows = [("a" if k % 4 else "b", t) for k, t in enumerate(times)] + [("c", 5), ("c", 5), (None, 1), ("d", None)]
    df = wide.createDataFrame(rows, "k string, us long").select("k", F.timestamp_micros("us").alias("at")).repartition(3)
    want = {}
    for key in "abc":
        start = None
        for t in sorted(t for k, t in rows if k == key):
            if start is None or t >= start + 500_000:
                start = t
            want[key, start] = want.get((key, start), 0) + 1
    assert {(r.k, r.start_us): r.n for r in rooms.throttled_from_first(df, "k", "at").collect()} == want


def test_bands_of_a_hot_key(wide):
    from lyrebird.operators import signals

    rng = np.random.default_rng(11)
    rows = [("hot" if k % 4 else f"k{k % 3}", int(a), int(a + rng.integers(0, 30)) if k % 100 else int(a + 900)) for k, a in enumerate(rng.integers(0, 9000, 700))]
    df = wide.createDataFrame(rows + rows[::3], "key string, start long, end long").repartition(4)  # some of them twice
    plain = {tuple(r) for r in signals.merged_bands(df, "key").collect()}
    assert {tuple(r) for r in signals.merged_bands(df, "key", spread=True).collect()} == plain and len(plain) > 20
    assert signals.merged_bands(df.limit(0), "key", spread=True).collect() == []


def test_furthest(wide):
    rng = np.random.default_rng(12)
    rows = [("hot" if k < 500 else f"k{k % 5}", k, int(v) if rng.random() < 0.3 else None) for k, v in enumerate(rng.integers(-(2**62), 2**62, 650))]
    got = {(r.k, r.i): r.most for r in sweeps.furthest(wide.createDataFrame(rows, "k string, i long, v long").repartition(3), ["k"], ["i"], F.col("v"), "most").collect()}
    assert got == {(k, i): max((v for q, j, v in rows if q == k and j < i and v is not None), default=None) for k, i, _ in rows}
