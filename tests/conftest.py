import pytest

from weftline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
