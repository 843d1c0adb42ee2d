import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

import __spark_entry__  # noqa: E402, F401  # sets the workers' path


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from meterlake.session import configure

    shared = tmp_path_factory.mktemp("shared")
    s = SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.session.timeZone": "UTC"}).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield configure(s)
    s.stop()
