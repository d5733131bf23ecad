import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from talefold.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """A session as users have it; with TALEFOLD_TEST_SESSION=engine one with the engine's settings."""
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    if os.environ.get("TALEFOLD_TEST_SESSION") == "engine":
        configure(s)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from talefold.session import _own_scratch, clear_scratch
    from talefold.sources.files import exists

    clear_scratch(s)
    assert not exists(s, _own_scratch(s))
    s.stop()


@pytest.fixture(scope="session")
def sf():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
