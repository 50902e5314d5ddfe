import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared_folder):
    session = local_session("newsloom-tests", partitions=4, memory="6g", spark__checkpoint__dir=str(shared_folder))
    yield session
    session.stop()
