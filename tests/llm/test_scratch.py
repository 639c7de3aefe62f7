"""Where intermediate tables go."""

import pytest

from lendscope.llm import scratch


class Session:
    def __init__(self, **settings):
        self.settings = {name.replace("_", "."): value for name, value in settings.items()}
        self.conf = self

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def set(self, name, value):
        self.settings[name] = value


def test_the_shared_folder_is_used():
    session = Session(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://x/y/")
    first, second = scratch.folder(session, "a"), scratch.folder(session, "a")
    assert first.startswith("hdfs://x/y/a-") and first != second


def test_a_cluster_without_one_is_refused():
    for master in ("spark://host:7077", "yarn", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.folder(Session(spark_master=master), "a")


def test_one_machine_may_go_without():
    session = Session(spark_master="local[2]")
    path = scratch.folder(session, "a")
    assert path.startswith(session.get("spark.checkpoint.dir"))
