"""Checkpoint-folder rules: session conf first, scratch only for a local master."""
import pytest

from graphssl.session import ensure_checkpoint_dir, write_table


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Ctx:
    def __init__(self, master, conf):
        self.master, self._conf, self.dir = master, _Conf(conf), None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d

    def getConf(self):
        return self._conf


class _Session:
    def __init__(self, master, conf):
        self.sparkContext = _Ctx(master, conf)
        self.conf = _Conf(conf)


def test_session_conf_is_used():
    s = _Session("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"


def test_cluster_without_setting_raises():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("spark://cluster:7077", {}))


def test_local_master_gets_scratch_folder():
    assert ensure_checkpoint_dir(_Session("local[2]", {}))


def test_existing_directory_wins():
    s = _Session("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs:///other"})
    s.sparkContext.dir = "hdfs:///already"
    assert ensure_checkpoint_dir(s) == "hdfs:///already"


def test_write_table_prunes_columns(spark):
    df = spark.range(10).selectExpr("id", "id % 2 = 0 AS finished", "array(1.0, 2.0) AS features")
    t = write_table(df, "probe")
    plan = t.where("NOT finished").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,finished:boolean>" in plan
    assert t.where("NOT finished").count() == 5
