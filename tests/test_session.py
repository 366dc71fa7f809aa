"""Where intermediate tables lie, and that they go."""

import os
from types import SimpleNamespace

import pytest

from cohortspark import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))
        assert session.shared_folder(fake(master, "hdfs:///shared/")) == "hdfs:///shared"


def test_one_process_may_leave_it_out():
    folder = session.shared_folder(fake("local[2]"))
    assert os.path.isdir(folder) and session.shared_folder(fake("local[2]")) == folder


def test_nothing_is_left_behind(spark):
    table = session.written(spark.range(5), "five")
    assert table.count() == 5
    folder = session.scratch_folder(spark).removeprefix("file:")
    assert any(name.startswith("five-") for name in os.listdir(folder))
    before = spark.conf.get("spark.checkpoint.dir")
    session.clean(spark)
    assert not os.path.exists(folder) and spark.conf.get("spark.checkpoint.dir") == before
