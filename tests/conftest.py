import pytest

from tracelode.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{where}", "spark.driver.memory": "2g", "spark.sql.warehouse.dir": f"{where}/warehouse"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
