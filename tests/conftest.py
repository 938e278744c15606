from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from bench import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
