"""Genotype arrays, FASTA blocks, file rules, scores at many thresholds and the evaluate command."""

import json
import random

import pytest
from pyspark.sql import functions as F
from table_rows import rows

from strandloom.operators import evaluate, genotypes, intervals
from strandloom.plans.run import main
from strandloom.sources import readers, writers

SCHEMA = "chrom string, pos long, ref string, alts array<string>, gt array<array<int>>"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_alternatives_go_and_numbers_follow(spark):
    d = table(spark, [("c", 1, "A", ["C", "GT", "G"], [[0, 3], [1, -1], [2]]), ("c", 2, "AC", ["A"], [[0, 1], [0, 0], [0]])])
    assert rows(genotypes.snps(d)) == [("c", 1, "A", ["C", "G"], [[0, 2], [1, -1], [0]])]
    assert rows(genotypes.trim_alts(genotypes.of_samples(d, [2, 0])).where("pos = 1")) == [("c", 1, "A", ["GT", "G"], [[1], [0, 2]])]


def test_rows_of_a_place_lose_no_allele(spark):
    d = table(spark, [("c", 1, "A", ["C"], [[0, 1], [0, 0], [-1, -1]]), ("c", 1, "A", ["G"], [[0, 1], [1, 0], [0, 1]])])
    assert rows(genotypes.rejoin(d)) == [("c", 1, "A", ["C", "G"], [[0, 1, 2], [2, 0], [0, 2]])]
    both, names = genotypes.merged([(d, ["x", "y", "z"]), (table(spark, [("c", 1, "AT", ["A", "G"], [[1, 2]]), ("c", 9, "T", [], [[0, 0]])]), ["x"])])
    assert names == ["x", "y", "z", "2:x"]
    assert rows(genotypes.bases(both)) == [("c", 1, "A", "AT,C,G", ["A|C|G", "G|A", "A|G", "A|G"]), ("c", 9, "T", "", [".", ".", ".", "T|T"])]


def test_restricted_sites_have_two_to_four_alleles(spark):
    d = table(spark, [("c", 1, "A", ["C", "G"], [[0, 0], [2, 2]]), ("c", 2, "A", ["C"], [[0, 0], [1, 1]]), ("c", 3, "A", ["*", "T"], [[2, 1], [0, 0]])])
    assert rows(genotypes.restricted(d, [0])) == [("c", 3, "A", ["T"], [[1, 0]])]
    assert rows(genotypes.restricted(d, [1, 0])) == [("c", 1, "A", ["G"], [[1, 1], [0, 0]]), ("c", 2, "A", ["C"], [[1, 1], [0, 0]]), ("c", 3, "A", ["T"], [[0, 0], [1, 0]])]


def test_thousands_of_samples_are_one_column(spark):
    d = table(spark, [("c", p, "A", ["C"], [[(i + p) % 2, 0] for i in range(2000)]) for p in range(3)])
    both, names = genotypes.merged([(d, [f"s{i}" for i in range(2000)]), (d, ["other", *[f"t{i}" for i in range(1999)]])])
    got = genotypes.bases(both).collect()
    assert len(got) == 3 and len(names) == 4000 and all(len(r.gt) == 4000 and r.gt[0] == ("C|A" if r.pos % 2 else "A|A") for r in got)


def test_command_restricts_a_call_file(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\te1\tn1\tother\tx1\n"
    line = lambda p, r, a, *g: "\t".join(["chr7", str(p), ".", r, a, ".", ".", ".", "GT", *g]) + "\n"
    lines = [line(3, "A", "G,T", "0|1", "0|0", "2|2", "0|0"), line(4, "A", "GT", "0|1", "0|0", "0|0", "1|0"), line(5, "C", "T", "0|0", "1/1", "0|0", ".|."), line(60, "C", "T", "0|1", "1|1", "0|0", "1|1")]
    (tmp_path / "all.vcf").write_text(head + "".join(lines))
    (tmp_path / "strict.bed").write_text("chr7\t0\t50\n")
    cfg = {"CHROM": "7", "prefix": str(tmp_path), "files": {"1000GP_files": {"vcf_initial": str(tmp_path / "all.vcf"), "vcf": "own.CHROMOSOME.vcf", "bed": str(tmp_path / "strict.bed")}}, "samples": {"Mexicans": ["x1"], "Africans": [], "Americans": ["n1", "gone"], "Europeans": ["e1"]}}
    (tmp_path / "c.json").write_text(json.dumps(cfg))
    main(["restrict_1kG", "-json", str(tmp_path / "c.json")])
    got, names = readers.vcf_arrays(spark, f"{tmp_path}/own.chr7.vcf")
    assert names == ["x1", "n1", "e1"]
    assert rows(got) == [("chr7", 2, "A", ["G"], [[0, 0], [0, 0], [0, 1]]), ("chr7", 4, "C", ["T"], [[-1, -1], [1, 1], [0, 0]])]


@pytest.mark.parametrize("bases", [7, 1000])
def test_fasta_by_lines(spark, tmp_path, bases):
    """Lines of unlike lengths over splits of some bytes, several files, blank lines, spaces behind lines, an empty contig."""
    rnd = random.Random(bases)
    text, want = "", {}
    for name in ("1 first", "chr2", "empty", "X"):
        text += f">{name}\n"
        seq = ""
        for _ in range(0 if name == "empty" else rnd.randint(1, 60)):
            part = "".join(rnd.choice("ACGTn") for _ in range(rnd.randint(0, 70)))
            seq, text = seq + part, text + part + rnd.choice(["", " ", "\r"]) + "\n"
        want[name.split()[0]] = seq
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">other\nACGT\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = readers.fasta_blocks(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")], bases).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    made = {}
    for r in sorted(got, key=lambda r: (r.contig, r.block)):
        assert len(made.get(r.contig, "")) == r.block * bases and len(r.part) <= bases
        made[r.contig] = made.get(r.contig, "") + r.part
    assert made == {k: v for k, v in want.items() if v} | {"other": "ACGT"}


def test_contig_names():
    of = readers.contig_of
    assert of(["chr10", "chr1"], "1") == "chr1" and of(["chr10", "1"], "chr1") == "1" and of(["A:11:x", "A:1:x"], "chr1") == "A:1:x"
    assert of(["chromosome 21", "chromosome 2"], "2") == "chromosome 2" and of(["ANC_10", "ANC_1"], "1") == "ANC_1" and of(["CHRX", "MAX1"], "X") == "CHRX"
    for names in (["chr10", "chr11"], ["a_1", "b_1"]):
        with pytest.raises(ValueError):
            of(names, "1")


def test_missing_window_files(spark, tmp_path):
    (tmp_path / "nd.bed").write_text("chr1\t0\t10\t0.5\nchr1\t10\t20\t0\n")
    nd, none = str(tmp_path / "nd.bed"), str(tmp_path / "none")
    ones = readers.exposures(spark, none, nd, "ones")
    assert rows(ones) == [("chr1", 0, 0, 10, 1.0, 1.0), ("chr1", 1, 10, 20, 1.0, 1.0)]
    spans = intervals.make_windows(spark.createDataFrame([("chr1", 15)], "chrom string, length long"), 10)
    assert rows(readers.exposures(spark, None, None, "ones", spans)) == [("chr1", 0, 0, 10, 1.0, 1.0), ("chr1", 1, 10, 15, 1.0, 1.0)]
    for args in ((none, nd, "zero"), (none, none, "ones")):
        with pytest.raises(FileNotFoundError):
            readers.exposures(spark, *args)


def test_masks_of_another_name(spark, tmp_path):
    (tmp_path / "7.bed").write_text("chr7\t0\t5\n")
    assert readers.other_name(spark, str(tmp_path / "chr7.bed")) == str(tmp_path / "7.bed") and readers.other_name(spark, str(tmp_path / "7.bed")) == str(tmp_path / "7.bed")
    with pytest.warns(UserWarning, match="no mask"):
        assert readers.other_name(spark, str(tmp_path / "chr8.bed")) is None
    assert readers.other_name(spark, None) is None


@pytest.mark.parametrize("cell", [5, 1 << 20])
def test_best_scores_and_sweep(spark, cell):
    rnd = random.Random(cell)
    pred = [(k, s := rnd.randint(0, 60), s + rnd.randint(0, 20), rnd.choice([0.2, 0.5, 0.9, None])) for k in ("a", "b") for _ in range(15)]
    true = [(k, s := rnd.randint(0, 70), s + rnd.randint(1, 9)) for k in ("a", "b", "c") for _ in range(4)]
    p, t = spark.createDataFrame(pred, "k string, s long, e long, score double"), spark.createDataFrame(true, "k string, s long, e long")
    at = {}
    for k, s, e, x in pred:
        for i in range(s, e):
            at[k, i] = max(at.get((k, i), -1), -1 if x is None else x)
    at = {k: v for k, v in at.items() if v >= 0}
    best = evaluate.best_scores(p, ["k"], cell).collect()
    assert {(r.k, i): r.score for r in best for i in range(r.s, r.e)} == at and sum(r.e - r.s for r in best) == len(at)
    want = {(k, i) for k, s, e in true for i in range(s, e)}
    for r in evaluate.threshold_sweep(t, p, ["k"], 16, [0.9, 0.1, 0.5, 0.95]).collect():
        hit = {k for k, v in at.items() if v >= r.threshold}
        assert (r.tp, r.fp, r.fn, r.segments) == (len(hit & want), len(hit - want), len(want - hit), sum(x is not None and x >= r.threshold and s < e for _, s, e, x in pred))


def test_evaluate_command(spark, tmp_path):
    seg = lambda name, data: writers.segments(spark.createDataFrame(data, "Sample string, CHROM string, Start long, End long, Length long, State string"), str(tmp_path / name))
    seg("truth", [("MX_0_1", "chr1", 0, 100, 100, "EU"), ("MX_0_1", "chr1", 100, 160, 60, "ND_EU"), ("MX_0_1", "chr1", 160, 200, 40, "AF")])
    seg("pred", [("MX_0_1", "chr1", 0, 119, 120, "EU"), ("MX_0_1", "chr1", 120, 199, 80, "ND_EU")])
    main(["evaluate", "-truth", str(tmp_path / "truth"), "-segments", str(tmp_path / "pred"), "-out", str(tmp_path / "a")])
    report = json.loads(spark.read.text(f"{tmp_path}/a/report").first()[0])
    assert report["accuracy"] == 140 / 200 and report["per_state"]["ND_EU"] == {"precision": 0.5, "recall": 40 / 60, "f1": 2 * 0.5 * (40 / 60) / (0.5 + 40 / 60), "support_bp": 60}
    (tmp_path / "dec").mkdir()
    (tmp_path / "dec" / "x.tsk_0.hap1.txt").write_text("chrom\tstart\tend\tstate\tmean_prob\n1\t100\t130\tArchaic\t0.9\n1\t150\t200\tArchaic\t0.6\n1\t0\t9\tHuman\t0.9\n")
    (tmp_path / "msp").write_text("#Subpopulation order/codes: EUR=0\tAFR=1\n#chm\tspos\tepos\tsgpos\tegpos\tn\ttsk_0.0\n1\t0\t160\t0\t0\t1\t0\n1\t160\t200\t0\t0\t1\t1\n")
    main(["evaluate", "-truth", str(tmp_path / "truth"), "-decoded", str(tmp_path / "dec"), "-least", "0.5", "0.8", "-out", str(tmp_path / "b")])
    table = {r.threshold: r for r in spark.read.csv(f"{tmp_path}/b/thresholds", sep="\t", header=True, inferSchema=True).collect()}
    assert (table[0.5].tp, table[0.5].fp, table[0.5].fn, table[0.5].segments) == (40, 40, 20, 2) and (table[0.8].tp, table[0.8].fp, table[0.8].segments) == (30, 0, 1)
    main(["evaluate", "-truth", str(tmp_path / "truth"), "-decoded", str(tmp_path / "dec"), "-msp", str(tmp_path / "msp"), "-populations", "EUR=EU", "AFR=AF", "-least", "0.5", "-out", str(tmp_path / "c")])
    report = json.loads(spark.read.text(f"{tmp_path}/c/report").first()[0])
    assert report["accuracy"] == (100 + 40 + 40) / 200 and report["per_state"]["AF"]["recall"] == 1.0
