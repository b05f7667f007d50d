from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordmill.streaming import windows

SCHEMA = StructType().add("who", "string").add("at", "timestamp").add("n", "integer")


def test_restart_late_rows_and_close(spark, tmp_path):
    data, closing = str(tmp_path / "data"), str(tmp_path / "closing")

    def put(*rows):
        times = [(w, f"2024-01-01 {t}", n) for w, t, n in rows]
        spark.createDataFrame(times, "who STRING, at STRING, n INT").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(data)

    def run():
        feed = lambda: windows.closable_feed(spark, data, closing, SCHEMA)
        total = [F.sum("n").alias("n")]
        hourly = lambda df: windows.tumbling(df, "at", "1 hour", "30 minutes", ["who"], total)
        quiet = lambda df: windows.sessions(df, "at", "30 minutes", "30 minutes", ["who"], total)
        found = []
        for name, transform in (("hourly", hourly), ("quiet", quiet)):
            out = str(tmp_path / name)
            windows.run_windows(spark, feed, transform, out, out + "-state")
            rows = spark.read.schema("who STRING, start_us LONG, end_us LONG, n LONG").parquet(out)
            listed = [(r.who, (r.end_us - r.start_us) // 60_000_000, r.n) for r in rows.collect()]
            found.append(sorted(listed, key=lambda r: (r[0] or "", r[1:])))
        return found

    put(("a", "00:10:00", 1), ("a", "00:30:00", 2), ("b", "01:05:00", 4), (None, "00:20:00", 8))
    # The watermark stands at 00:35: no hour and no session is over.
    assert run() == [[], []]
    put(("b", "03:00:00", 16))
    run()
    # At 02:30 the row of 00:40 is late.
    put(("a", "00:40:00", 64), ("b", "03:10:00", 128))
    run()
    windows.close(spark, closing, SCHEMA, "at")
    hourly, quiet = run()
    assert hourly == [(None, 60, 8), ("a", 60, 3), ("b", 60, 4), ("b", 60, 144)]
    assert quiet == [(None, 30, 8), ("a", 50, 3), ("b", 30, 4), ("b", 40, 144)]
