import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tractscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="tractscope-tests", shuffle_partitions=8,
                      conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ts-ckpt-"),
                            "spark.sql.maxMetadataStringLength": "10000"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="ts-test-")
