import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quernis.session import local_session

    os.environ.setdefault("BENCH_MEMORY", "6g")
    s = local_session(8, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
