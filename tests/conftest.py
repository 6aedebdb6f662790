import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from obsframe.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def points(spark):
    """Build a metrics frame from (name, labels, ts_ms, value) rows; seq is the row number."""
    def make(rows):
        data = [(n, dict(labels), float(v), int(t), i) for i, (n, labels, t, v) in enumerate(rows)]
        return spark.createDataFrame(data, "name string, labels map<string,string>, value double, ts_ms bigint, seq bigint")
    return make
