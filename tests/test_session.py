"""Where intermediate tables go."""

import types

import pytest

from tonegrid import session


def fake(master, conf=None, folder=None):
    return types.SimpleNamespace(
        conf=types.SimpleNamespace(get=lambda name, other: conf or other), sparkContext=types.SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: folder)
    )


def test_shared_folder_is_never_a_machine_s_own_on_a_cluster():
    assert session.shared_folder(fake("spark://x:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert session.shared_folder(fake("yarn", None, "hdfs:///given")) == "hdfs:///given"
    assert session.shared_folder(fake("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_folder(fake(master))


def test_materialize_and_discard(spark):
    d = session.materialize(spark.range(5))
    assert sorted(r.id for r in d.collect()) == [0, 1, 2, 3, 4]
    files = d.inputFiles()
    session.discard(d)
    import os

    assert not os.path.exists(files[0].removeprefix("file://"))
