from types import SimpleNamespace

import pytest

from lexigrid.shared import shared_dir


def session(master, conf=None, checkpoint=None):
    settings = {} if conf is None else {"spark.checkpoint.dir": conf}
    option = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: settings.get(k, d), set=settings.__setitem__), sparkContext=context)


def test_the_cluster_names_the_folder():
    assert shared_dir(session("spark://h:7077", "hdfs:///x/")) == "hdfs:///x"
    assert shared_dir(session("yarn", None, "hdfs:///set")) == "hdfs:///set"
    own = session("local[4]")
    assert shared_dir(own).startswith("file:///") and shared_dir(own) == shared_dir(own)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
