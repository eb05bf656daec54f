import datetime as dt

import numpy as np

from cellmill.streaming.assign import group_totals, nearest_group


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    t = dt.datetime(2024, 1, 1)
    data = [(i, rng.normal(size=3).tolist(), t + dt.timedelta(minutes=i)) for i in range(200)] + [(900, None, t), (901, [1.0], t), (902, [float("nan")] * 3, t)]
    spark.createDataFrame(data, "id bigint, v array<double>, at timestamp").write.parquet(f"{tmp_path}/in")
    c = spark.createDataFrame([(7, [0.0, 0.0, 0.0]), (9, [1.0, 1.0, 1.0])], "g bigint, centroid array<double>")
    batch = {r["id"]: r["g"] for r in nearest_group(spark.read.parquet(f"{tmp_path}/in"), c).collect()}
    want = {i: (7 if np.dot(v, v) <= np.sum((np.array(v) - 1) ** 2) else 9) for i, v, _ in data[:200]}
    assert batch == want | {900: None, 901: None, 902: None}
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = group_totals(nearest_group(stream, c), "at").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from totals where g is not null").first()[0] == 200
