from pyspark.sql import functions as F

from gitsift import session


class Stub:
    """A session of another kind, as far as the folder is concerned."""

    def __init__(self, master, root=None):
        self.master, self.root, self.applicationId = master, root, f"app-{master}-{root}"
        self.sparkContext = self.conf = self

    def get(self, key, default):
        return self.root or default


def test_scratch_folder():
    assert session.scratch_root(Stub("spark://host", "hdfs://shared")) == "hdfs://shared"
    assert session.scratch_root(Stub("local[2]")) == session.scratch_root(Stub("local[2]"))
    for master in ("spark://host", "local-cluster[2,1,1024]"):
        try:
            session.scratch_root(Stub(master))
        except ValueError:
            continue
        raise AssertionError(master)


def test_stage_and_distinct_commits(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), (None, 2, 5), ("b", None, 5)], "sha string, x int, y int")
    one = session.stage(session.distinct_commits(df, "x", "sha"), "t")
    assert sorted(map(tuple, one.collect())) == [("a", 1), ("b", None)] and one.columns == ["sha", "x"]
    assert session.stage(df.where(F.lit(False)), "t").count() == 0
