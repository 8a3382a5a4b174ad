import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from routegrid.plans.settings import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", partitions=4, folder=tempfile.mkdtemp(prefix="spark-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Numbered molecule texts as a table."""
    def make(texts):
        return spark.createDataFrame(list(enumerate(texts)), "mol_id bigint, smiles string")
    return make
