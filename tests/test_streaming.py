from datetime import datetime, timedelta

from quernstone.streaming.arrivals import first_deliveries, windowed_counts


def run(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def stream(spark, tmp_path, batches):
    path = str(tmp_path / "s")
    for b in batches:
        spark.createDataFrame(b, "id string, at timestamp, k string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id string, at timestamp, k string").option("maxFilesPerTrigger", 1).parquet(path)


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = run(first_deliveries(stream(spark, tmp_path, [[("a", t, "x"), (" ", t, "x")], [("a ", t + timedelta(hours=1), "x"), ("b", t, "y")]]), "id", "at"), "firsts", spark)
    assert len(rows) == 2 and {r["id"].strip() for r in rows} == {"a", "b"}


def test_windows_close_with_the_watermark(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = run(windowed_counts(stream(spark, tmp_path, [[("a", t, "x"), ("b", t, "x")], [("c", t + timedelta(days=9), "x")], [("d", t + timedelta(days=9), "x")]]), "at", "1 day", ["k"]), "counts", spark)
    assert [(r["k"], r["n"]) for r in rows] == [("x", 2)]
