import os
from types import SimpleNamespace

import pytest

from tessera import session


def test_cut_files_lie_in_the_named_folder_and_go_when_released(spark):
    kept = session.cut(spark.range(10))
    folder = session.shared_dir(spark)
    assert "tessera-" + spark.sparkContext.applicationId in folder
    assert kept.count() == 10 and os.listdir(folder.removeprefix("file:"))
    session.release(spark)
    assert not [f for f in os.listdir(folder.removeprefix("file:")) if not f.startswith(".")]


def test_a_cluster_without_a_shared_folder_is_refused():
    none = SimpleNamespace(isDefined=lambda: False, isEmpty=lambda: True)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
