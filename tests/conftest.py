import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ludograph.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
                                "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
