import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIX = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chatsieve.session import get_session
    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.driver.memory": "4g"})
    from chatsieve.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="chatsieve-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="chatsieve-test-")


def needs(path):
    return pytest.mark.skipif(not os.path.exists(path), reason=f"{path} not available")
