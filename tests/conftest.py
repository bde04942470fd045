import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelscope.session import build_session, ensure_checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=4, app="panelscope-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ps-test-ckpt-")})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
