"""The shared folder: taken from the session, temporary on a local master only, swept on demand."""

from types import SimpleNamespace

import pytest
from lodeweave.session import shared_dir, sweep, written


class Conf(dict):
    def set(self, key, value):
        self[key] = value

    def get(self, key, default=None):
        return dict.get(self, key, default)


def fake(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(fake(master))
        assert shared_dir(fake(master, **{"spark.checkpoint.dir": "hdfs:///cuts"})) == "hdfs:///cuts"
    assert shared_dir(fake("local[2]")).startswith("file:///")


def test_written_copies_are_swept(spark):
    from pathlib import Path

    copy = written(spark.range(5).toDF("id"), "some")
    folder = Path(shared_dir(spark).removeprefix("file://")) / spark.sparkContext.applicationId
    assert copy.count() == 5 and list(folder.glob("some-*"))
    sweep(spark)
    assert not folder.exists()
