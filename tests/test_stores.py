"""Layouts that spare reading and moving: what the plans of their readers say, and that rows are the same."""

import re

from pyspark.sql import functions as F
from table_rows import rows

from strandloom.functions.hmm_params import Transitions
from strandloom.operators import evaluate, hmm, tracts
from strandloom.sources import stores

T = Transitions(ti=1500, tmex=20, rr=2e-6, a=0.4, b=0.4, c1=0.1, c2=0.1, width=1000)
KEYS, RATES = ["chrom", "hap"], [0.5, 4.0, 1.5, 1.0, 0.3]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calls_by_chromosome_and_place(spark, tmp_path):
    calls = spark.range(4000).selectExpr("concat('chr', id % 3) AS chrom", "id * 100 AS pos", "'A' AS ref", "array('C') AS alts", "array(array(0, int(id % 2))) AS gt")
    stores.write_calls(calls, ["s"], str(tmp_path))
    region = spark.createDataFrame([("chr1", 1000, 2000), ("chr1", 200_000, 201_000), ("chr2", 5, 5)], "chrom string, s long, e long")
    got, names = stores.read_calls(spark, str(tmp_path), region=region)
    want = calls.where("chrom = 'chr1' AND (pos BETWEEN 1000 AND 1999 OR pos BETWEEN 200000 AND 200999)")
    assert names == ["s"] and rows(got) == rows(want) and len(rows(want)) > 4
    text = plan(got)
    assert re.search(r"PartitionFilters: \[[^\]]*chrom", text) and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(pos,1000\)", text)
    one, _ = stores.read_calls(spark, str(tmp_path), chrom="chr2")
    assert all("/chrom=chr2/" in f for f in one.inputFiles()) or one.select(F.input_file_name().alias("f")).where("f NOT LIKE '%chrom=chr2%'").isEmpty()
    assert one.count() == calls.where("chrom = 'chr2'").count() and stores.read_calls(spark, str(tmp_path), region=region.limit(0))[0].count() == 0


def test_bounds_hold_wherever_the_region_does(spark):
    region = spark.createDataFrame([("a", i * 10, i * 10 + 3) for i in range(50)] + [("b", 7, 9)], "chrom string, s long, e long")
    places = spark.range(600).selectExpr("explode(array('a', 'b', 'c')) AS chrom", "id AS pos")
    inside = places.join(region, "chrom").where("pos >= s AND pos < e").count()
    for told, most in ((100, 256), (100, 3), (100, 1)):
        kept = places.where(stores.bounds(region, told, most))
        assert kept.join(region, "chrom").where("pos >= s AND pos < e").count() == inside
    assert places.where(stores.bounds(region, 100)).count() < 500


def test_no_exchange_over_bucketed_tables(spark, tmp_path):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    data = hmm.sample(spark, 6, 200, RATES, T.log_matrix()).cache()
    truth = tracts.runs(data, KEYS).withColumn("state", tracts.state_name(F.col("state")))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        counts = stores.bucketed(data, "t_counts", str(tmp_path / "c"), KEYS, 4, ["win"])
        packed = hmm.pack(counts, KEYS)
        path = stores.bucketed(hmm.decode(packed, KEYS, RATES, T.log_matrix()), "t_path", str(tmp_path / "p"), KEYS, 4, ["win"])
        made = tracts.absorb_tracts(path, KEYS).withColumn("state", tracts.state_name(F.col("state")))
        conf = evaluate.confusion(stores.bucketed(truth, "t_truth", str(tmp_path / "t"), KEYS, 4, ["s"]), made, KEYS, 50_000)
        for df in (hmm.decode(packed, KEYS, RATES, T.log_matrix()), made):
            assert "Exchange" not in plan(df)
        assert "chrom" not in "".join(x for x in plan(conf).splitlines() if "Exchange" in x)
        got = rows(conf)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    whole = tracts.absorb_tracts(hmm.decode(hmm.pack(data, KEYS), KEYS, RATES, T.log_matrix()), KEYS).withColumn("state", tracts.state_name(F.col("state")))
    assert got == rows(evaluate.confusion(truth, whole, KEYS, 50_000))
