from utterlake.plans import corpus_queries


def test_utterances_that_start_before_the_recording(spark, tmp_path):
    spark.createDataFrame([("m", 25_000)], "org_media_path string, duration_ms bigint").write.parquet(f"{tmp_path}/recordings.parquet")
    rows = [("m", -500, 200), ("m", -900, 10_001), ("m", -900, 0), ("m", -900, -100), ("m", 9_999, 10_000), ("m", None, 5), ("m", 3, 3)]
    spark.createDataFrame(rows, "org_media_path string, start_time bigint, end_time bigint").write.parquet(f"{tmp_path}/utterances.parquet")
    found = {(r["slice"], r["n"]) for r in corpus_queries.QUERIES["slice_overlaps"](spark, str(tmp_path)).collect()}
    assert found == {(0, 3), (1, 1)}
