import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Catalogue rows from sparse dicts."""
    from shelfmark import schema

    def make(*dicts):
        fields = {f.name: f.dataType for f in schema.CATALOGUE.fields}
        data = [tuple(d.get(n) for n in fields) for d in dicts]
        return spark.createDataFrame(data, schema.CATALOGUE)

    return make
