"""Plain prefix doubling over every byte position, in Spark: what op3 would be without sampled positions.

It checks op3's result by the method's own definition. Run as a script with a data folder, it prints what it and
op3 shuffle, as a multiple of the text, and their seconds.
"""

import sys
import time

import pytest
from helpers import SF
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from pixelsieve.llm import repeated_text as X
from pixelsieve.llm.common import cut, read

FIRST = 25  # 25, 50, 100, 200, 400 bytes


def repeated_positions(docs, length=400):
    """doc, pos of every string of `length` bytes that occurs again, by ranks of position pairs; unique ones are
    dropped in each round."""
    texts = docs.select(F.monotonically_increasing_id().alias("doc"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"))
    texts = cut(texts.filter(F.octet_length("t") >= length))

    def reranked(rows, *names):
        same = Window.partitionBy(*names)
        rows = rows.withColumn("n", F.count("*").over(same)).withColumn("rank", F.min(F.struct("doc", "pos")).over(same))
        return cut(rows.filter("n > 1").select("doc", "pos", "rank"))

    at = F.explode(F.sequence(F.lit(1), F.octet_length("t") - FIRST + 1)).alias("pos")
    ranks = reranked(texts.select("doc", "t", at).select("doc", "pos", F.substring("t", F.col("pos"), F.lit(FIRST)).alias("name")), "name")
    reach = FIRST
    while reach < length:
        further = ranks.select("doc", (F.col("pos") - reach).alias("pos"), F.col("rank").alias("next"))
        ranks = reranked(ranks.join(further, ["doc", "pos"]), "rank", "next")
        reach *= 2
    return texts, ranks


@pytest.fixture(scope="module")
def removed(spark):
    docs = read(spark, SF, "documents")
    texts, ranks = repeated_positions(docs)
    starts = {}
    for r in ranks.collect():
        starts.setdefault(r["doc"], set()).add(r["pos"] - 1)
    of = {r["doc"]: (r["doc_id"], r["text"]) for r in docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text").collect()}
    return {i: len({k for s in starts.get(d, ()) for k in range(s, s + 400)}) for d, (i, _) in of.items()}


def test_as_op3(spark, removed):
    assert {r["doc_id"]: r["n_removed"] for r in X.op3_repeated_text(spark, SF).collect()} == removed
    assert any(removed.values())


def _moved(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "10g").config("spark.sql.shuffle.partitions", "32").config("spark.ui.retainedStages", "100000").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = read(spark, sys.argv[1], "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for name, run in (("doubling", lambda: repeated_positions(docs)[1].count()), ("op3", lambda: X.op3_repeated_text(spark, sys.argv[1]).write.format("noop").mode("overwrite").save())):
        before, began = _moved(spark), time.monotonic()
        run()
        print(name, size, "bytes of text;", round(time.monotonic() - began, 1), "s; shuffled", round((_moved(spark) - before) / size, 2), "x", flush=True)
