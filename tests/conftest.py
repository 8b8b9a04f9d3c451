import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from prismlake.session import session

    found = session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
