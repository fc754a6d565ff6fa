"""The streamed model equals the batch fold."""

from pyspark.sql import functions as F
from weftline.functions.times import time_key
from weftline.operators.statistics import weekly_model
from weftline.streaming.model import learn


def test_streamed_model(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("observable"), "value").where("observable = 'click'").orderBy("ts").limit(60)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = learn(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with timeouts pending, empty batches would go on for ever
    q = stream.writeStream.format("memory").queryName("learned").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {r.timekey: (r.n, round(r.expect, 6), round(r["var"], 6)) for r in spark.table("learned").collect()}
    batch = weekly_model(spark.read.parquet(str(tmp_path / "in")).withColumn("timekey", time_key(F.col("ts"))))
    assert got == {r.timekey: (r.n, round(r.expect, 6), round(r["var"], 6)) for r in batch.collect()}
