from siftline.streaming import incremental as inc


def test_files_are_processed_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    spark.range(10).repartition(5).write.parquet(src)
    go = lambda: inc.process_files(spark, src, "id long", lambda b: b.selectExpr("id", "id * 2 as x"), out, chk, files_per_batch=2).awaitTermination(60)
    go()
    assert inc.complete(inc.results(spark, out), spark.range(10), "id").first().complete
    spark.range(10, 14).coalesce(1).write.mode("append").parquet(src)
    go()
    got = inc.results(spark, out)
    assert got.count() == 14 and inc.complete(got, spark.range(14), "id").first().complete


def test_windows_of_alerts(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*600) as ts, cast(id as double) as value from range(24)")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = inc.running_alerts(stream, "ts", "value", 20.0).writeStream.outputMode("complete").format("memory").queryName("alerts").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start.hour: (r.events, r.alerts) for r in spark.sql("select * from alerts").collect()}
    assert got == {0: (6, 0), 1: (6, 0), 2: (6, 0), 3: (6, 4)}


def test_run_once(spark, tmp_path):
    p, calls = str(tmp_path / "o"), []
    for _ in range(2):
        assert inc.run_once(spark, p, lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1]
