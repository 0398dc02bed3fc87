"""The shared folder: required off a local master, one folder per application."""

import pytest

from gridwatch import session


class Context:
    def __init__(self, master):
        self.master = master
        self.applicationId = "app-1"

    def getCheckpointDir(self):
        return None


class Conf:
    def get(self, key, default=None):
        return default


class Session:
    def __init__(self, master):
        self.sparkContext, self.conf = Context(master), Conf()


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session(master))


def test_local_masters():
    assert session.is_local("local") and session.is_local("local[*]") and not session.is_local("local-cluster[1,1,1]")


def test_paths_lie_below_the_application(spark):
    path = session.shared_path(spark, "a", "b")
    assert path == f"{session.application_path(spark)}/a/b" and spark.sparkContext.applicationId in path


def test_remove_path(spark, scratch):
    import os

    spark.range(3).write.parquet(f"{scratch}/t")
    assert session.remove_path(spark, f"{scratch}/t") and not os.path.exists(f"{scratch}/t")
