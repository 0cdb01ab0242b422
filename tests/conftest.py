import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["TOKENIZERS_PARALLELISM"] = "false"

SF = os.environ.get("MILLRACE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session, ship

    session = local_session(cores=os.environ.get("MILLRACE_TEST_CORES", "4"), memory="4g", partitions=4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
