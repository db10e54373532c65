"""The shared folder: the session's own, else one of the context's on one machine, else an error."""

from types import SimpleNamespace

import pytest

from docgauge.llm.common import shared_dir


class Settings(dict):
    def set(self, *_):
        raise RuntimeError("CANNOT_MODIFY_CONFIG")


def session(master, **settings):
    own = Settings(settings)
    return SimpleNamespace(conf=own, sparkContext=SimpleNamespace(master=master, getConf=lambda: own))


def test_shared_dir():
    spark = session("local[2]")
    a, b = shared_dir(spark, "a"), shared_dir(spark, "b")
    assert a.startswith("file:///") and a.rpartition("/")[0] == b.rpartition("/")[0] and a != b
    assert shared_dir(session("spark://x", **{"spark.checkpoint.dir": "hdfs://x/y/"}), "n").startswith("hdfs://x/y/n-")
    with pytest.raises(RuntimeError, match="shared|share"):
        shared_dir(session("spark://x"), "n")
