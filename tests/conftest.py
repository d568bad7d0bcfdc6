import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def few_rows_are_hot(monkeypatch):
    """Make skew handling start at two rows per key."""
    from docweave.functions import ranks

    monkeypatch.setattr(ranks, "HOT_ROWS", 1)
    monkeypatch.setattr(ranks, "HOT_SALTS", 3)
