from tessaprobe.sources.tables import SCHEMAS
from tessaprobe.streaming import tables as streams


def test_level_means_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(3):
        rows = [(u, float(s), "n", "l", (u + s + k) / 50, "m", 1.0, 2.0) for u in range(5) for s in (0, 5)] + [(9, None, "n", "l", 0.5, "m", 1.0, 1.0)]
        spark.createDataFrame(rows, SCHEMAS["cka_snr"]).coalesce(1).write.mode("append").parquet(folder)
    query = streams.level_means(streams.read_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("means").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.layer, r.snr): (round(r.CKA, 9), r.n) for r in spark.table("means").collect()}
    want = {(r.layer, r.snr): (round(r.CKA, 9), r.n) for r in streams.level_means(spark.read.schema(SCHEMAS["cka_snr"]).parquet(folder)).collect()}
    assert got == want and len(got) == 2
