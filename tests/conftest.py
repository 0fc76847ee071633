import pytest

from tallyloom import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session.build(
        "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
