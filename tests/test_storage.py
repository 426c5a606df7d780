import pytest

from geolith import storage


class Conf:
    def __init__(self, spark, master):
        self._spark, self.master = spark, master
        self.sparkContext = self
        self.conf = self
        self._jsc = self

    applicationId = "nowhere"

    def get(self, *_):
        return None

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return False


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    with pytest.raises(RuntimeError):
        storage.shared_folder(Conf(spark, "spark://host:7077"))
    assert storage.shared_folder(Conf(spark, "local[2]")) == storage.shared_folder(Conf(spark, "local[2]"))


def test_tables_are_saved_dropped_and_cleared(spark):
    scratch = storage.Scratch(spark, "kept")
    saved = scratch.save(spark.range(5))
    other = scratch.save(spark.range(7).selectExpr("id", "id % 2 as k"), by=("k",))
    assert saved.count() == 5 and other.where("k = 1").count() == 3
    fs, at = storage.file_system(spark, scratch.root)
    scratch.drop(saved)
    assert len(fs.listStatus(at)) == 1
    storage.clear(spark)
    assert not fs.exists(at)
