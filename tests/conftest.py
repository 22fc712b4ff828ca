import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexivane.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of a column expression over one row of given inputs."""

    def value(expression, **inputs):
        kinds = ", ".join(
            f"{name} {'binary' if isinstance(v, (bytes, bytearray)) else 'int' if isinstance(v, int) else 'string'}"
            for name, v in inputs.items()
        )
        row = tuple(inputs.values())
        return spark.createDataFrame([row], kinds).select(expression).first()[0]

    return value
