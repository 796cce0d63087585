"""A streamed as-of join writes what the batch join gives."""

from pyspark.sql import functions as F

from tidemark.operators.temporal import asof_bucketed
from tidemark.streaming.asof import stream_asof

SF = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(SF)
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("signup_id"))
    left.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(left.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_asof(stream, right, f"{tmp_path}/out", "ts", "at", ["user_id"], ["signup_id"], ["signup_id"]).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = asof_bucketed(left, right, "ts", "at", ["user_id"], ["signup_id"], ["signup_id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
