import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridwatch.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    """A fresh folder under the session's shared checkpoint folder."""
    from gridwatch.session import shared_path

    return shared_path(spark, "tests", fresh=True)
