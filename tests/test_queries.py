"""Every query of the engine against the same in SQL."""

import os
import random
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pixelsieve.plans import queries as q

SF = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).parent


def plain(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n in q.SQL])
def test_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    cur = duck.execute(q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(names).collect())
    assert got == sorted(tuple(plain(x) for x in r) for r in cur.fetchall())


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.SQL])
def test_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0 or name.endswith("keypoints")


def test_pcc(spark, tmp_path):
    """Values 17 to 64 count: pairs that agree on the first 16 differ."""
    rng = random.Random(3)
    first = [rng.uniform(-1, 1) for _ in range(16)]
    rows = [(i, first + [rng.uniform(-1, 1) for _ in range(48)], 0) for i in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    pixels = {r["vec_id"]: r["p"] for r in q.r8(spark, str(tmp_path)).collect()}
    mean = lambda x: sum(x) / 64
    std = lambda x: (sum((v - mean(x)) ** 2 for v in x) / 64) ** 0.5

    def brute(a, b):
        return max(sum((a[k] - mean(a)) * (b[(k - t) % 64] - mean(b)) for k in range(64)) / 64 for t in range(64)) / (std(a) * std(b))

    got = {(r["id_a"], r["id_b"]): r["distance"] for r in q.QUERIES["pcc"](spark, str(tmp_path)).collect()}
    assert len(got) == 6
    for (a, b), value in got.items():
        assert abs(value - brute(pixels[a], pixels[b])) < 2e-6 and value < 0.99


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(q.QUERIES) <= set(entry.queries())


def test_training_data_operators_stand_alone():
    """Nothing outside their folders imports them, but for the entry module's guarded import."""
    for path in [*ROOT.glob("*.py"), *(ROOT / "pixelsieve").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        inside = "llm" in path.relative_to(ROOT).parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py")
        assert inside or not re.search(r"import.*pixelsieve[.]llm|from pixelsieve[.]llm|from pixelsieve import.*\bllm\b", path.read_text()), path
