import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillspark.session import session

    folder = tmp_path_factory.mktemp("spark")
    return session("local[4]", 4, spark__checkpoint__dir=str(folder / "checkpoints"), spark__sql__warehouse__dir=str(folder / "warehouse"))
