import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from emberline.session import build_session, use_scratch_dir

    session = build_session(
        "emberline-tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.sql.streaming.stateStore.providerClass": (
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
            ),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    use_scratch_dir(session)
    yield session


@pytest.fixture
def strings(spark):
    """Evaluate column functions over a list of strings."""

    def evaluate(values, function):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [row[0] for row in frame.select(function("v").alias("r"), "i").orderBy("i").collect()]

    return evaluate
