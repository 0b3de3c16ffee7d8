import numpy as np

from strandloom.functions.hmm_params import Transitions
from strandloom.operators import hmm
from strandloom.streaming import windows

RATES = np.array([0.5, 4.0, 1.5, 1.0, 0.3])
T = Transitions(1500, 20, 1e-8, 0.4, 0.5, 0.02, 0.03, 1000)


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_window_counts(spark, tmp_path):
    spark.sql("SELECT 1L AS hap, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, IF(id % 2 = 0, 'a', 'b') AS kind FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("hap long, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    got = drain(windows.window_counts(stream, {"a": "o_a", "b": "o_b"}, "2 minutes", "0 seconds"), "counts", "complete")
    assert sorted((r.o_a, r.o_b) for r in got.collect()) == [(1, 1)] * 5


def test_forward_filter_ends_like_the_batch(spark, tmp_path):
    data = hmm.sample(spark, 2, 40, RATES, T.log_matrix())
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    got = drain(windows.forward_filter(stream.drop("chrom", "s", "e", "state"), RATES, T.log_matrix()), "filtered")
    last = {r.hap: np.array(r[2:7]) for r in got.where("win = 39").collect()}
    batch = hmm.posteriors(hmm.pack(data, ["chrom", "hap"]), ["chrom", "hap"], RATES, T.log_matrix()).where("win = 39")
    for r in batch.collect():
        assert np.allclose(last[r.hap], [r[f"g{i}"] for i in range(5)], atol=1e-9)
