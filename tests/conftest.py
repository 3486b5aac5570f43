import pytest

from fanloom import session


@pytest.fixture(scope="session")
def spark():
    return session.local("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
