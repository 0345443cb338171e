import pytest

from repolume import workspace


def test_the_configured_folder_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert workspace.shared_folder(spark) == folder
    first, second = workspace.new_path(spark, "a"), workspace.new_path(spark, "a")
    assert first.startswith(folder) and first != second


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master):
        self.sparkContext = Context(master)
        self.conf = {}


def test_without_the_setting_only_local_sessions_get_a_folder():
    local = Session("local[2]")
    assert workspace.shared_folder(local) == workspace.shared_folder(local)
    with pytest.raises(RuntimeError):
        workspace.shared_folder(Session("spark://host:7077"))
