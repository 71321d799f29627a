from types import SimpleNamespace

import pytest

from rivulet.llm import store


def fake(folder, master="local[8]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))


def test_the_cluster_names_the_folder():
    assert store.shared_dir(fake("hdfs://x/y/")) == "hdfs://x/y"
    assert store.shared_dir(fake("hdfs://x/y/", "spark://host:7077")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        store.shared_dir(fake(None, "spark://host:7077"))
    unset = fake(None)
    assert store.shared_dir(unset).startswith("file:///") and store.shared_dir(unset) == store.shared_dir(unset)


def test_tables_are_read_back(spark):
    df = spark.range(10).repartition(5)
    back = store.materialize(df, "test", files=2)
    assert sorted(r.id for r in back.collect()) == list(range(10)) and back.rdd.getNumPartitions() <= 2 + 8
    assert store.materialize(df.filter("id < 0"), "test").collect() == []


def test_released_tables_are_gone(spark):
    import os

    table = store.materialize(spark.range(3), "test")
    path = table._rivulet_path.removeprefix("file://")
    assert os.path.isdir(path)
    store.release(table)
    assert not os.path.exists(path)
