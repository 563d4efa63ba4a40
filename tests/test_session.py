from types import SimpleNamespace

import pytest

from clausewise.session import scratch_dir, spread, write_shared


def session(master, **settings):
    """What ``scratch_dir`` asks a session for."""
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(conf=settings, sparkContext=context)


def test_shared_folder(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    warehouse = {"spark.sql.warehouse.dir": "/house/"}
    for master in ("local", "local[*]", "local[4,2]"):
        assert scratch_dir(session(master, **warehouse)) == "/house/clausewise-scratch-app-1"
    assert scratch_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs:/c"})) == "hdfs:/c"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session(master, **{"spark.sql.warehouse.dir": "/house"}))


def test_write_shared_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "array(id) AS a")
    back = write_shared(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert "LocalTable" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_spread_leaves_enough_splits_alone(spark):
    wide = spark.range(0, 100, 1, 32)
    assert spread(wide) is wide
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
