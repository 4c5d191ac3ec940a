import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from support import DATA  # noqa: E402

from cargolake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", partitions=4, memory="4g", **{
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shipments(spark):
    from cargolake.catalog.views import Views
    if not Path(DATA).exists():
        pytest.skip("sample tables are not there")
    return Views(spark, DATA).shipments.cache()
