"""The shared checkpoint folder."""

import pytest

from panelscope.session import ensure_checkpoint_dir


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return _Conf()


class _Session:
    sparkContext, conf = _Context(), _Conf()


def test_unset_folder_raises_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session())


def test_set_folder_is_used(spark):
    assert ensure_checkpoint_dir(spark)
