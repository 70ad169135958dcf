import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark
    s = get_spark("local[4]", app="quarry-tests", shuffle_partitions=4)
    yield s
    s.stop()
