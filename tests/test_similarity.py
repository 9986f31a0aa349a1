import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelsieve.functions import metrics
from pixelsieve.operators import similarity as sim


def hashes(seed, n, length, groups):
    rng = random.Random(seed)
    bases = [[rng.randrange(256) for _ in range(length)] for _ in range(groups)]
    out = []
    for k in range(n):
        h = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 6)):
            bit = rng.randrange(8 * length)
            h[bit // 8] ^= 1 << bit % 8
        out.append((k, h))
    return out


def distance(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


@pytest.mark.parametrize("length,threshold", [(8, 0), (8, 3), (8, 7), (2, 4), (5, 11), (32, 31), (1, 7)])
@pytest.mark.parametrize("expected", [100, 10**6, 10**12])
def test_join(spark, length, threshold, expected):
    rows = hashes(length, 150, length, 12)
    got = {(r["id_a"], r["id_b"], r["distance"]) for r in sim.hamming_join(spark.createDataFrame(rows, "i long, h array<int>"), "i", "h", length, threshold, expand=True, expected=expected).collect()}
    want = {(i, j, float(distance(a, b))) for i, a in rows for j, b in rows if i < j and distance(a, b) <= threshold}
    assert got == want and want
    pairs = sim.hamming_join(spark.createDataFrame(rows, "i long, h array<int>"), "i", "h", length, threshold, expand=True, expected=expected)
    assert pairs.count() == len(want)
    first = {}
    for i, h in rows:
        first.setdefault(tuple(h), i)
    classes = sim.hamming_join(spark.createDataFrame(rows, "i long, h array<int>"), "i", "h", length, threshold, expected=expected)
    assert sorted(map(tuple, classes.collect())) == sorted((i, j, d) for i, j, d in want if d and first[tuple(rows[i][1])] == i and first[tuple(rows[j][1])] == j)
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()


def test_threshold_too_large():
    with pytest.raises(ValueError):
        sim.lay_out(1, 8)


def test_bands():
    """Hashes within the threshold have a band within the flips; few of random hashes are candidates."""
    rng = random.Random(2)
    for length, threshold in [(32, 31), (8, 10), (2, 2), (16, 3)]:
        for expected in (10**3, 10**6, 10**10):
            b = sim.lay_out(length, threshold, expected)
            assert b.lows[0] == 0 and b.lows[-1] == 8 * length and max(b.widths) <= sim.WIDEST
            for _ in range(200):
                x = sum(1 << i for i in rng.sample(range(8 * length), threshold))
                assert any((x >> lo & (1 << w) - 1).bit_count() <= b.flips for lo, w in zip(b.lows, b.widths))
                for k, w in enumerate(b.widths):
                    assert len(set(b.masks(k))) == len(b.masks(k)) and max(m.bit_count() for m in b.masks(k)) <= b.flips and max(b.masks(k)) < 1 << w
    b = sim.lay_out(32, 31)
    assert sum(len(b.masks(k)) / 2**w for k, w in enumerate(b.widths)) < 0.01


def test_candidates(spark):
    """Hashes of 32 bytes, threshold 31: the rows that the join on bands makes, counted, are far below all pairs."""
    rng = random.Random(8)
    rows = [(i, [rng.randrange(256) for _ in range(32)]) for i in range(2000)]
    bands = sim.lay_out(32, 31)
    met = 0
    for lo, w, masks in zip(bands.lows, bands.widths, map(bands.masks, range(len(bands.widths)))):
        held = {}
        for _, h in rows:
            v = int.from_bytes(bytes(h), "little") >> lo & (1 << w) - 1
            held[v] = held.get(v, 0) + 1
        met += sum(n * held.get(v ^ m, 0) for v, n in held.items() for m in masks) - len(rows)
    assert met / 2 < 0.01 * len(rows) ** 2 / 2
    assert sim.hamming_join(spark.createDataFrame(rows, "i long, h array<int>"), "i", "h", 32, 31).count() == 0


def test_nearest(spark):
    rows = hashes(3, 60, 8, 5)
    df = spark.createDataFrame([(i, h, i % 4) for i, h in rows], "i long, h array<int>, k int")
    for key in (None, "k"):
        got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in sim.nearest(df, "i", "h", 2, metrics.hamming, key).collect()}
        for i, h in rows:
            others = sorted((float(distance(h, g)), j) for j, g in rows if j != i and (key is None or j % 4 == i % 4))
            assert [got[i, 1], got[i, 2]] == [(j, d) for d, j in others[:2]]


def test_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i long, h string")
    assert {tuple(r) for r in sim.equal_groups(df, "i", "h").collect()} == {("a", 1, 2), ("b", 2, 1)}


def test_nearest_within(spark):
    rows = hashes(4, 80, 4, 6)
    df = spark.createDataFrame(rows, "i long, h array<int>")
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in sim.nearest_within(df, "i", "h", 4, 3, 6).collect()}
    want = {}
    for i, h in rows:
        others = sorted((float(distance(h, g)), j) for j, g in rows if j != i and distance(h, g) <= 6)
        want |= {(i, k + 1): (j, d) for k, (d, j) in enumerate(others[:3])}
    assert got == want


def test_nearest_refuses_large_tables(spark, monkeypatch):
    monkeypatch.setattr(sim, "BROADCAST_ROWS", 10)
    df = spark.createDataFrame(hashes(3, 11, 8, 5), "i long, h array<int>")
    with pytest.raises(ValueError, match="nearest_within"):
        sim.nearest(df, "i", "h", 2, metrics.hamming)


@pytest.mark.parametrize("metric", list(metrics.MATRICES), ids=lambda m: m.__name__)
@pytest.mark.parametrize("whole", [True, False])
def test_pairs_compared_by_the_block(spark, metric, whole):
    """The same rows as a join with the metric's column, whatever the blocks; one common key is spread over tasks."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 4, (90, 6)) if whole else rng.normal(size=(90, 6)) ** 2
    vectors[:3] = 0
    rows = [(k - 20 if k < 85 else 7, None if k == 4 else "x" if k % 10 else "y", v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"id long, key string, v array<{'int' if whole else 'double'}>")
    want = sim.pairs_within(df, "key", "id", ["v"]).select("id_a", "id_b", (F.round(metric(F.col("v_a"), F.col("v_b")), 6) + 0.0).alias("distance"))
    got = sim.compared_within(df, "key", "id", "v", metrics.MATRICES[metric], 6, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    per_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < 0.5 * sum(r["count"] for r in per_task)


def test_null_vectors_have_null_distances(spark):
    df = spark.createDataFrame([(1, 0, [1, 2]), (2, 0, None), (3, 0, [2, 1]), (None, 0, [1, 1])], "id long, key int, v array<int>")
    got = sim.compared_within(df, "key", "id", "v", metrics.MATRICES[metrics.l2], 3).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [(1, 2, None), (1, 3, 1.414), (2, 3, None)]
    assert sim.compared_within(df.where("id < 0"), "key", "id", "v", metrics.MATRICES[metrics.l2], 3).count() == 0


def test_rounds_as_spark(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-8, 12, 300), np.round(rng.normal(size=300), 3) + 0.0005, [0.0005, 1.0005, 2.5e-4, -0.0005, 1.0005e12, 0.0, np.inf, 1e22]])
    want = [r[0] for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double").orderBy("k").select(F.round("x", 3) + 0.0).collect()]
    assert sim.rounded(x, 3).tolist() == want
