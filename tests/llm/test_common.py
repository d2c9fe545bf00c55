import pytest
from pyspark.sql import functions as F

from quillsift.llm import common


def test_settled_tables_come_back_and_go(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "even").alias("kind"), F.array("id").alias("list"))
    kept = common.settle(rows)
    assert kept.dtypes == rows.dtypes and sorted(r["id"] for r in kept.collect()) == list(range(100))
    assert common.settle(rows.limit(0)).count() == 0
    assert common.clear_settled(spark) >= 2 and common.clear_settled(spark) == 0


def test_a_stage_leaves_its_result_only(spark):
    common.clear_settled(spark)

    def stage():
        first = common.settle(spark.range(10))
        return common.settle(first.where("id > 3")).where("id < 8")

    out = common.settle_alone(stage)
    assert sorted(r["id"] for r in out.collect()) == [4, 5, 6, 7] and common.clear_settled(spark) == 1
    kept = common.settle(spark.range(3))
    common.forget(kept, spark.range(2))
    assert common.clear_settled(spark) == 0 and not common._UNDER_WAY


def test_texts(spark):
    rows = spark.createDataFrame([(None,), ("é",)], "text string").select(common.text_or_empty().alias("t"), common.sha256_hex(common.text_or_empty()).alias("h")).collect()
    assert [r["t"] for r in rows] == ["", "é"] and rows[0]["h"].startswith("e3b0c442")


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    session = MagicMock()
    session.sparkContext.getCheckpointDir.return_value, session.sparkContext.master = None, "spark://host:7077"
    session.conf.get.return_value = None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
    session.conf.get.return_value = "hdfs://shared"
    common.shared_dir(session)
    session.sparkContext.setCheckpointDir.assert_called_once_with("hdfs://shared")
