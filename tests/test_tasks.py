"""Tasks and batches of bounded size."""

from pyspark.sql import functions as F

from bugloom.functions.text import unescape_entities
from bugloom.session import spread
from catalog import compose, queries


def test_entities_are_resolved_row_by_row(spark):
    texts = spark.createDataFrame([("a &lt; b",), (None,), ("plain",), ("&amp;lt;",)], "text string")
    plan = texts.select(unescape_entities(F.col("text")).alias("text"))
    assert [r[0] for r in plan.collect()] == ["a < b", None, "plain", "&lt;"]
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().toString()


def test_order_texts_are_dealt_to_small_tasks(spark, tmp_path):
    rows = [(k, k, "F", "1-URGENT") for k in range(500)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    texts = queries.order_submissions(compose.JAVA_TEXT)(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() >= queries.TASKS_PER_SPLIT and texts.count() == 500
    stored = spark.read.parquet(str(tmp_path / "orders.parquet"))
    assert spread(stored, 3).rdd.getNumPartitions() == max(3, spark.sparkContext.defaultParallelism)
