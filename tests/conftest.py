import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from loomframe.session import local_session

    s = local_session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
