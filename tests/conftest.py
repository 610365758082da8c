import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", partitions=4, spark__sql__adaptive__coalescePartitions__enabled="true")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted rows of a DataFrame as tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
