from types import SimpleNamespace

import pytest

from pixelsieve.llm import common


def session(master, where=None, known=None):
    set_to = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: known, setCheckpointDir=set_to.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: where)), set_to


def test_checkpoint_folder():
    """A cluster needs a shared folder by name; one machine may do with a temporary one."""
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.ensure_checkpoint_dir(session(master)[0])
        spark, set_to = session(master, "hdfs:///shared")
        common.ensure_checkpoint_dir(spark)
        assert set_to == ["hdfs:///shared"]
    for master in ("local", "local[4]", "local[*]"):
        spark, set_to = session(master)
        common.ensure_checkpoint_dir(spark)
        assert len(set_to) == 1
    spark, set_to = session("yarn", known="hdfs:///known")
    common.ensure_checkpoint_dir(spark)
    assert not set_to


def test_cut(spark):
    """All rows, in their order within partitions; no estimate of a size; both sides of a join may be one table."""
    df = spark.range(20).repartition(3, "id").sortWithinPartitions("id").selectExpr("id", "nullif(id, 3) as x", "'a' as `odd name`")
    wide = df
    for _ in range(5):
        wide = common.cut(wide.join(wide.select("id"), "id"))
    assert wide.schema == df.schema and sorted(wide.collect()) == sorted(df.collect())
    assert wide._jdf.queryExecution().optimizedPlan().stats().simpleString().endswith("EiB")
    kept = common.cut(df)
    assert kept.rdd.glom().collect() == df.rdd.glom().collect()
    assert kept.alias("l").join(kept.alias("r"), "x").count() == 19
    assert common.cut(df.limit(0)).count() == 0
