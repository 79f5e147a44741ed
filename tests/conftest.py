import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from storepulse.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="storepulse-wh-"),
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="storepulse-test-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def retail(spark):
    from storepulse.sources.retail import retail_tables
    return retail_tables(spark, SF_SMALL)
