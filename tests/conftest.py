import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from prefloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4)


@pytest.fixture()
def failing():
    """Runs a query that must fail and returns the error text."""

    def run(df):
        with pytest.raises(Exception) as caught:
            df.collect()
        return str(caught.value)

    return run
