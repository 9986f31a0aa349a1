import zlib
from collections import Counter

from helpers import EDGE_TEXTS, SF, doc, save

from pixelsieve.llm import sharding as S


def test_law_and_mixture(spark):
    out = S.op2_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    shards = Counter(r["shard"] for r in out)
    assert set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    sources = Counter(d["source"] for d in docs.values())
    for source, n in sources.items():
        per = Counter(r["shard"] for r in out if docs[r["doc_id"]]["source"] == source)
        assert all(abs(per[s] - n / 16) <= 1.5 for s in range(16))
    for r in out:
        text = docs[r["doc_id"]]["text"].encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "rows" and r["grown_shard"] is None


def test_edges(spark, tmp_path):
    rows = [doc(i, t, source=[None, "a", "hot"][i % 3]) for i, t in enumerate(EDGE_TEXTS)] + [doc(3, "dup"), doc(3, "dup"), doc(None, "x")]
    out = S.op2_sharding(spark, save(spark, tmp_path, rows)).collect()
    assert len(out) == len(rows) and Counter(r["shard"] for r in out).most_common(1)[0][1] == 1
    assert S.op2_sharding(spark, save(spark, tmp_path, [])).count() == 0


def test_many_single_row_sources(spark):
    df = spark.range(400).selectExpr("id doc_id", "cast(id as string) source", "id shard")
    out = S.interleave(df, 7).collect()
    n = Counter(r["shard"] for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 7


def test_same_result_again(spark):
    a, b = ({(r["doc_id"], r["shard"], r["slot"]) for r in S.op2_sharding(spark, SF).collect()} for _ in range(2))
    assert a == b


def test_no_python(spark):
    plan = S.op2_sharding(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ties(spark):
    """Rows of one id and size keep their places however they arrive."""
    rows = [(1, "s", 5, k) for k in range(40)] + [(2, None, 5, k) for k in range(5)]
    places = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, source string, size long, crc long").repartition(3)
        places.append(sorted(map(str, S.interleave(df, 4, ties=("size", "crc")).collect())))
    assert places[0] == places[1]
