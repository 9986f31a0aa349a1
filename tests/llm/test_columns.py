"""Extra columns, and columns whose names clash with an operator's own or with each other."""

import pytest
from pyspark.sql import functions as F

from pixelsieve.llm import bpe, exact_dedup, fingerprints, jaccard_join, language_id, packing, repeated_text, secrets, sharding

ROWS = [(i, t, "en", "s", 7) for i, t in enumerate(["one two three four", "one two three four", "x", None, "password=hunter22 zz"])]


@pytest.fixture
def df(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["id", "n", "row", "__s", "__h", "__id", "__gone", "spans", "shard", "slot", "kept", "found", "pack", "length", "rank", "component_id", "bucket", "tie", "copy", "h1", "name", "node", "rep"]
    return rows.select("*", *[F.lit(f"extra {c}").alias(c) for c in extra], F.lit("other text").alias("text"), F.lit("again").alias("extra.dot"))


def test_operators(df):
    first = df.toDF(*[c if k < 5 else f"{c}{k}" for k, c in enumerate(df.columns)])
    assert sharding.interleave(first, 3).count() == 5
    assert sharding.interleave(df, 3).select("shard").distinct().count() == 3
    assert exact_dedup.exact_duplicates(df).filter("kept").count() == 4
    assert jaccard_join.jaccard_components(df, 3, 90).select("component_id").distinct().count() == 4
    assert repeated_text.remove_repeats(df).count() == 5
    assert packing.pack(df).count() == 5
    assert bpe.encode_decode(df).count() == 5
    assert fingerprints.fingerprints(df).count() == 5
    assert sum(r["kind"] == 0 for r in secrets.scan(df).select(F.explode("spans").alias("s")).select("s.*").collect()) == 1


def test_filters_keep_all_columns(df):
    known = language_id.train(df)
    steps = [(exact_dedup.drop_exact_duplicates(df), 4), (jaccard_join.drop_near_duplicates(df, 3, 90), 4), (language_id.keep_known(df, known), 4), (secrets.redact(df), 5)]
    for out, n in steps:
        assert out.columns == df.columns
        assert out.toDF(*[f"c{k}" for k in range(len(df.columns))]).count() == n
    assert secrets.redact(df).toDF(*[f"c{k}" for k in range(len(df.columns))]).filter("c1 like '%[SECRET]%'").count() == 1
