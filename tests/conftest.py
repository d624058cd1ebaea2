import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodeworks.session import session

    top = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.warehouse.dir": f"file://{top}/warehouse", "spark.checkpoint.dir": f"file://{top}/shared", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.default.parallelism": "4"}
    s = session("local[8]", 4, **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
