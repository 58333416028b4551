import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tremorline.session import build

    shared = tmp_path_factory.mktemp("shared")
    return build(
        "local[4]", 4,
        **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(shared / "warehouse")},
    )


@pytest.fixture(scope="session")
def sf():
    return SF
