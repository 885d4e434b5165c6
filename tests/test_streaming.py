from tidelog.plans import policy_queries, stream_queries

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_delivery_stream_equals_its_batch_twin(spark):
    assert rows(stream_queries.stream_delivery(spark, SF)) == rows(policy_queries.delivery(spark, SF))


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    from tidelog.operators.folds import Rotation
    from tidelog.streaming.runs import ROCKS, stream_fold

    data = spark.createDataFrame([(1, i, 10) for i in range(6)], "k long, seq long, frame_size long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def run():
        s = stream_fold(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), ["k"], ["seq"], lambda: Rotation(4, 10_000))
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    data.where("seq < 3").coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    data.where("seq >= 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [r["segment_id"] for r in out] == [1, 1, 1, 1, 2, 2]


def test_a_fold_goes_on_over_micro_batches_and_gathers_no_key(spark, tmp_path):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tidelog.operators.folds import SeenSet, _Resumed, ordered_fold
    from tidelog.streaming.runs import fold_to_table

    data = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"), (F.col("id") * 7 % 11).alias("message_id"))
    data = data.withColumn("k", F.when(F.col("k") > 0, F.col("k")))  # a null key is a key
    for i in range(3):
        data.where(f"seq div 1000 = {i}" + (" AND k = 1" if i == 1 else "")).orderBy(F.desc("seq")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = fold_to_table(stream, ["k"], ["seq"], lambda: SeenSet(5), ["k", "seq", "seen"], "test")
    want = ordered_fold(spark.read.parquet(f"{tmp_path}/in"), ["k"], ["seq"], lambda: SeenSet(5)).select("k", "seq", "seen")
    assert rows(got) == rows(want)
    (tmp_path / "none").mkdir()
    assert fold_to_table(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/none"), ["k"], ["seq"], lambda: SeenSet(5), ["seq", "seen"], "test").count() == 0

    # a batch of a key that goes on is done with before the next one comes, and keeps nothing but the state
    walk = _Resumed(["k"], lambda: SeenSet(5))
    one = pa.RecordBatch.from_pydict({"k": [1] * 4, "message_id": [1, 2, 1, 3], "_state": pa.nulls(4, pa.binary())})
    assert walk.fold(one, ["k"]).column("seen").to_pylist() == [False, False, True, False] and not walk.out
    assert walk.fold(one, ["k"]).column("seen").to_pylist() == [True] * 4 and len(walk.state.ids) == 3
