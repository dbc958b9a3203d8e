import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from repoloom.session import build_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("4", "tests", **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture
def staging(spark):
    from repoloom.sources.staging import Staging

    folder = Staging(spark)
    yield folder
    folder.close()
