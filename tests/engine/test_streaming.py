from lineagraph.streaming.members import latest_members, upsert_into


def test_stream_keeps_the_latest_member(spark, tmp_path):
    schema = "collection_id long, key string, member_id long, checkpoint long"
    spark.createDataFrame([(1, "k", 10, 1), (1, "k", 11, 5), (2, "k", 12, 2)], schema).write.parquet(f"{tmp_path}/in")
    table = {"now": spark.createDataFrame([(1, "k", 9, 0), (3, "k", 7, 0)], schema)}

    def write(df):
        table["now"] = spark.createDataFrame(df.collect(), df.schema)

    apply = upsert_into(lambda: table["now"], write, ["collection_id", "key"])
    stream = latest_members(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").foreachBatch(apply).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.collection_id, r.member_id) for r in table["now"].collect()) == [(1, 11), (2, 12), (3, 7)]
