"""One small local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from statuta.session import local_session

    session = local_session(4, partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest tables of the driver; tests that need it are skipped without it."""
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no driver tables here")
    return str(folder)
