import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from visitlens.session import configure  # noqa: E402

SAMPLES = os.environ.get("SAMPLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]").appName("visitlens-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "6g")
               # Small inputs: compiling plans would take longer than running them.
               .config("spark.sql.codegen.wholeStage", "false")
               .config("spark.ui.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def sample_dir():
    if not os.path.isdir(SAMPLES):
        pytest.skip("sample tables not present")
    return SAMPLES
