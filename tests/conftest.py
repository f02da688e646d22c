import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from marketweave.session import get_spark
    scratch = tempfile.mkdtemp(prefix="mw-tests-")
    s = get_spark("marketweave-tests", master="local[4]", shuffle_partitions=8,
                  extra_conf={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                              "spark.local.dir": os.path.join(scratch, "local")})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="mw-case-")
