import pytest

from quillstat import session
from quillstat.llm import common


class _Session:
    """A session without any checkpoint folder."""

    class sparkContext:
        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

    class conf:
        @staticmethod
        def get(key, default=None):
            return "/local/warehouse" if "warehouse" in key else default


def test_no_shared_folder_is_an_error():
    """The library never falls back to a folder of one machine."""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(_Session(), "table")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session())


def test_written_lies_below_the_checkpoint_folder(spark):
    t = common.written(spark.range(3).toDF("a"), "small")
    folder = spark.sparkContext.getCheckpointDir().split(":")[-1]
    assert t.count() == 3 and all(folder in f for f in t.inputFiles())
