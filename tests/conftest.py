import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from modelgate.session import get_spark

    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    s = get_spark("local[4]", app_name="modelgate-tests", shuffle_partitions=8, extra_conf=shared)
    yield s


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
