import os
from types import SimpleNamespace

import pytest

from mutprox import session


def test_cut_and_scratch(spark):
    was = spark.conf.get(session.CLEANUP)
    with session.scratch(spark):
        inner = session.cut(spark.range(10))
        with session.scratch(spark):
            innermost = session.cut(inner.groupBy().count())
            assert innermost.head()[0] == 10
        assert not os.path.exists(innermost.cut_path.removeprefix("file:")) and inner.count() == 10
    assert not os.path.exists(inner.cut_path.removeprefix("file:"))
    assert spark.conf.get(session.CLEANUP) == was
    kept = session.cut(spark.range(3))
    session.drop_cut(kept)
    assert not os.path.exists(kept.cut_path.removeprefix("file:"))


@pytest.mark.parametrize(("master", "fine"), [("local[4]", True), ("local", True), ("spark://host:7077", False), ("local-cluster[2,1,1024]", False)])
def test_no_local_folder_on_a_cluster(master, fine):
    made = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default))
    if fine:
        assert session.shared_dir(fake)
    else:
        with pytest.raises(ValueError):
            session.shared_dir(fake)
