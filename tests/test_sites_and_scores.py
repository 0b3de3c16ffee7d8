import math

from pyspark.sql import functions as F

from strandloom.functions import alleles, scalars
from strandloom.functions.binomial import tails
from strandloom.operators import evaluate, observe
from strandloom.operators.tracts import STATES
from table_rows import rows


def test_observations_golden(spark):
    wins = spark.createDataFrame([("chr1", 0, 0, 1000), ("chr1", 1, 1000, 2000), ("chr1", 2, 3000, 4000)], "chrom string, win long, s long, e long")
    sites = [
        (0, "A", "{A}", "{A,G}", "{A}", "{A}", "G", "A"), (999, "C", "{}", "{C}", "{C}", ".", "T", "T"), (1000, "a", "{A}", "{A}", "{A}", "{A}", "G", "G"),
        (2499, "G", "{G}", "{G}", "{G}", "{G}", "T", "T"), (3000, "G", "{G}", "{G}", "{G}", "{G}", "g", "."), (4000, "G", "{G}", "{G}", "{G}", "{G}", "T", "T"),
    ]
    wide = spark.createDataFrame([("chr1", *x) for x in sites], "chrom string, pos long, anc string, EU string, NA string, AF string, ND string, H1 string, H2 string")
    got = {(r.hap, r.win): (r.o_eu, r.o_na, r.o_af, r.o_nd) for r in observe.observations(wide, wins, 1000).collect()}
    assert got == {("H1", 0): (1, 1, 2, 1), ("H1", 1): (0, 0, 0, 0), ("H1", 2): (0, 0, 0, 0), ("H2", 0): (0, 1, 1, 0), ("H2", 1): (0, 0, 0, 0), ("H2", 2): (0, 0, 0, 0)}


def test_empty_panel_keeps_a_site_but_makes_no_difference(spark):
    df = spark.createDataFrame([(["A"], "{}")], "mx array<string>, p string")
    panel = alleles.allele_set(F.col("p"))
    assert df.select(alleles.keep_site(F.col("mx"), [panel]), alleles.absent(panel, F.lit("A"))).first()[:] == (True, False)


def test_genotypes(spark):
    df = spark.createDataFrame([("A|G",), ("T",), ("./.",), (None,)], "g string")
    assert rows(df.select(alleles.haplotypes(F.col("g")).alias("h")).select("h.h1", "h.h2")) == [(".", "."), (".", "."), ("A", "G"), ("T", ".")]


def test_confusion_golden(spark):
    t = spark.createDataFrame([("x", 0, 5000, "EU"), ("x", 5000, 8000, "ND_EU")], "k string, s long, e long, state string")
    p = spark.createDataFrame([("x", 0, 5999, "EU"), ("x", 6000, 7999, "ND_EU")], "k string, s long, e long, state string")
    assert rows(evaluate.confusion(t, p, ["k"], 1000)) == [("EU", "EU", 5000), ("ND_EU", "EU", 999), ("ND_EU", "ND_EU", 1999)]
    mask = spark.createDataFrame([("x", 0, 10000)], "k string, s long, e long")
    conf = evaluate.confusion(t, evaluate.half_open(p, True), ["k"], 1000, mask)
    assert rows(conf) == [("EU", "EU", 5000), ("ND_EU", "EU", 1000), ("ND_EU", "ND_EU", 2000)]
    report = {r.state: r for r in evaluate.report(conf, STATES).collect()}
    assert report["EU"].precision == 5000 / 6000 and report["ND_EU"].recall == 2000 / 3000 and math.isnan(report["AF"].recall) and report["AF"].total_bp == 8000


def test_binary_golden(spark):
    t = spark.createDataFrame([(1, 10, 30)], "k int, s long, e long")
    p = spark.createDataFrame([(1, 20, 40)], "k int, s long, e long")
    got = {r.view: r for r in evaluate.interval_metrics(t, p, ["k"], 100, 16).collect()}
    assert (got["Archaic"].tp, got["Archaic"].fp, got["Archaic"].fn, got["Archaic"].tn, got["Archaic"].f1) == (10, 10, 10, 70, 0.5)
    assert got["Modern"].precision == got["Modern"].recall == got["Modern"].f1 == 0.875


def test_binomial_golden(spark):
    cases = [(0, 10, 0.3), (10, 10, 0.3), (3, 10, 0.0), (3, 10, 1.0), (1, 2, 0.5), (1, 0, 0.5), (7, 20, 0.3)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k long, n long, p double")
    got = [tuple(r) for r in df.select("i", *tails(F.col("k"), F.col("n"), F.col("p"))).orderBy("i").collect()]
    want = [(1, 0.7**10), (0.3**10, 1), (0, 1), (1, 0), (0.75, 0.75), (math.nan, math.nan), (0.3919901877990756, None)]
    for (_, a, b), (x, y) in zip(got, want, strict=True):
        for u, v in ((a, x), (b, y)):
            assert v is None or (math.isnan(u) and math.isnan(v)) or abs(u - v) < 1e-12


def test_scalars(spark):
    df = spark.createDataFrame([(0.25, 2, 0.0), (0.75, 2, 1.0)], "p double, n long, z double")
    got = [tuple(r) for r in df.select(scalars.whole_count(F.col("p"), F.col("n")), scalars.ratio(F.col("p"), F.col("z"), -1.0), scalars.fraction_bin(F.col("z"), 10)).collect()]
    assert got == [(0, -1.0, 0), (2, 0.75, 9)]
