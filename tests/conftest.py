import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chronoloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, partitions=4, memory="3g")
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def folder():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)
