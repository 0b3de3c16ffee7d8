import gzip
import json

import pytest

from strandloom.sources import readers, writers
from table_rows import rows


def put(path, text):
    path.write_text(text)
    return str(path)


def test_bed_and_windows(spark, tmp_path):
    at = put(tmp_path / "w.bed", "chrom start end\n# note\n1 0 1000 5 0.5\nchr1\t1000\t2000\t1\nbad line\n1 x 3000 1\n")
    assert rows(readers.windows_bed(spark, at)) == [("chr1", 0, 0, 1000, 0.5), ("chr1", 1, 1000, 2000, 1.0)]
    with gzip.open(tmp_path / "m.bed.gz", "wt") as f:
        f.write("1 0 10\n1 10 20\n2 5 9\n")
    lengths = readers.chrom_lengths(spark, put(tmp_path / "sizes", "chr1 15\n"))
    assert rows(readers.bed(spark, str(tmp_path / "m.bed.gz"), lengths)) == [("chr1", 0, 15)]


def test_missing_exposure(spark, tmp_path):
    at = put(tmp_path / "w.bed", "1 0 1000 0.5\n")
    assert rows(readers.exposures(spark, at, None), "l_mod", "l_anc") == [(0.5, 0.0)]
    assert rows(readers.exposures(spark, at, str(tmp_path / "none"), "ones"), "l_mod", "l_anc") == [(1.0, 1.0)]


def test_gaps_in_both_layouts(spark, tmp_path):
    at = put(tmp_path / "gaps", "585 chr1 0 10\nchr2 5 9\n3 1 4\n")
    assert rows(readers.gaps(spark, at)) == [("chr1", 0, 10), ("chr2", 5, 9), ("chr3", 1, 4)]
    assert readers.gaps(spark, str(tmp_path / "none")).count() == 0


def test_state_na_stays_text(spark, tmp_path):
    at = put(tmp_path / "s.tsv", "Sample\tCHROM\tStart\tEnd\tLength\tState\nMX_1\t1\t0\t9\t10\tNA\n")
    assert rows(readers.segments(spark, at, True)) == [("chr1", "MX_1", 0, 10, "NA")]
    with pytest.raises(ValueError):
        readers.segments(spark, put(tmp_path / "t.tsv", "Sample\tCHR\tStart\tEnd\nx\t1\t0\t9\n"), False)


def test_sites(spark, tmp_path):
    at = put(tmp_path / "v.tsv", "#CHROM\tPOS\tREF\tALT\tAncestral\tND\tEU\tNA\tAF\tA_1\tA_2\n1\t10\tA\tG\tA\t.\t{A}\t{A,G}\t{}\tG\tA\n1\tx\tA\tG\tA\t.\t{A}\t{A}\t{}\tG\tA\n")
    assert rows(readers.sites(spark, at), "chrom", "pos", "NA", "A_1", "A_2") == [("chr1", 9, "{A,G}", "G", "A")]
    old = put(tmp_path / "old.tsv", "chr\tPOS\tREF\tALT\tAncestral\tOutgroup\tNeand\tA_1\n1\t10\tA\tG\tA\t{A}\t{G}\tG\n")
    assert rows(readers.sites(spark, old), "ND", "EU", "A_1") == [("{G}", "{A}", "G")]


def test_msp_and_decoded(spark, tmp_path):
    at = put(tmp_path / "x.msp", "#Subpopulation order/codes: EUR=0\tNAT=1\n#chm\tspos\tepos\tsgpos\tegpos\tn\ttsk_3.0\ttsk_3.1\n1\t0\t10\t0\t1\t2\t0\t1\n")
    assert rows(readers.msp(spark, at, {"EUR": "EU"})) == [("chr1", "MX_3_1", 0, 10, 0, "EU"), ("chr1", "MX_3_2", 0, 10, 1, "NAT")]
    put(tmp_path / "tsk_4.hap2.decoded.txt", "chrom\tstart\tend\tstate\tmean_prob\n1\t0\t10\tArchaic\t0.9\n1\t10\t20\tHuman\t0.9\n1\t20\t30\tArchaic\t0.4\n")
    assert rows(readers.decoded(spark, str(tmp_path / "tsk_4*"), 0.5)) == [("chr1", "MX_4_2", 0, 10, 0.9)]


def test_decoded_files_put_together(spark, tmp_path):
    n, at = 300, str(tmp_path / "together")
    text = "CASE WHEN id % 3 = 0 THEN 'Human' ELSE 'Archaic' END AS state, CASE WHEN id % 7 = 0 THEN 0.25D ELSE 0.75D END AS mean_prob"
    df = spark.range(n).selectExpr("format_string('run_tsk_%d.hap%d', id div 2, id % 2 + 1) AS run", "'1' AS chrom", "id AS start", "id + 10 AS end", *text.split(", "))
    writers.decoded(df.repartition(3), at)
    assert len(list((tmp_path / "together").glob("*.csv"))) <= 3
    df.limit(20).coalesce(1).write.partitionBy("run").csv(str(tmp_path / "apart"), sep="\t", header=True)
    got = rows(readers.decoded(spark, at, 0.5, file="run"))
    assert got == sorted(("chr1", f"MX_{i // 2}_{i % 2 + 1}", i, i + 10, 0.75) for i in range(n) if i % 3 and i % 7)
    assert set(rows(readers.decoded(spark, str(tmp_path / "apart"), 0.5))) <= set(got)


def test_ancestral_bases_are_found_in_small_pieces(spark):
    seq = "".join("ACGTN"[(i * i + i // 7) % 5] for i in range(3 * readers.PIECE + 5))
    places = [-1, 0, readers.PIECE - 1, readers.PIECE, 1499, 1500, 2 * readers.PIECE, len(seq) - 1, len(seq), 10**6]
    sites = spark.createDataFrame([("chr1", p) for p in places], "chrom string, pos long")
    blocks = readers.blocks_of(spark.createDataFrame([("1", seq)], "contig string, seq string"), 1500)
    got = readers.ancestral(sites, blocks, 1500)
    assert {r.pos: r.anc for r in got.collect()} == {p: seq[p] if 0 <= p < len(seq) else "." for p in places}
    assert "_piece" in got._jdf.queryExecution().optimizedPlan().toString()


def test_vcf_fasta_files(spark, tmp_path):
    at = put(tmp_path / "x.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t5\t.\tA\tG,T\t.\t.\t.\tGT:DP\t0|2:7\n1\t9\t.\tC\tG\t.\t.\t.\tGT\t./.\n")
    region = spark.createDataFrame([("chr1", 4, 6)], "chrom string, s long, e long")
    assert rows(readers.vcf(spark, at), "pos", "S") == [(4, "A|T"), (8, ".|.")] and rows(readers.vcf(spark, at, "chr1", region), "pos") == [(4,)]
    fa = readers.fasta(spark, put(tmp_path / "x.fa", ">1 first\nACG\nT\n>21\nGG\n"))
    assert rows(fa) == [("1", "ACGT"), ("21", "GG")]
    sites = spark.createDataFrame([("chr1", 3), ("chr1", 4), ("chr2", 0)], "chrom string, pos long")
    assert rows(readers.ancestral(sites, readers.blocks_of(fa))) == [("chr1", 3, "T"), ("chr1", 4, "."), ("chr2", 0, ".")]


def test_config_and_files(spark, tmp_path):
    at = put(tmp_path / "seed_12.json", json.dumps({"prefix": "~/x", "samples": {"Mexicans": ["m"]}}))
    assert not readers.config(spark, at)["prefix"].startswith("~")
    with pytest.raises(FileNotFoundError):
        readers.config(spark, str(tmp_path / "none.json"))
    assert rows(readers.find_files(spark, str(tmp_path), "*.json"), "name", "seed") == [("seed_12.json", 12)]
    plan, lacking = readers.column_plan(["CHROM", "POS", "REF", "ALT", "n1", "m"], {"Mexicans": ["m", "q"]})
    assert plan == {"Mexicans": [5], "neand": [4]} and lacking == ["q"]


def test_writers(spark, tmp_path):
    seg = spark.createDataFrame([("s", "chr1", 0, 9, 10, "NA")], "Sample string, CHROM string, Start long, End long, Length long, State string")
    writers.segments(seg, str(tmp_path / "out"))
    assert rows(readers.segments(spark, str(tmp_path / "out"), True), "state") == [("NA",)]
    conf = spark.createDataFrame([("EU", "EU", 5), ("EU", "AF", 2)], "truth_state string, pred_state string, bp long")
    writers.confusion_text(conf, ["EU", "AF"], str(tmp_path / "conf"))
    assert "EU\t5\t2" in "".join(p.read_text() for p in (tmp_path / "conf").glob("part*"))


def test_summaries(spark, tmp_path):
    put(tmp_path / "mod_25.nd_3.json", json.dumps({"accuracy": 0.5, "total_bp": 7, "per_state": {"EU": {"precision": 1.0, "support_bp": 4}}}))
    got = readers.summaries(spark, str(tmp_path / "*.json"), {"modern": r"mod_(\d+)", "nd": r"nd_(\d+)"})
    assert rows(got, "modern", "nd", "accuracy", "state", "precision", "recall", "support_bp") == [("25", "3", 0.5, "EU", 1.0, None, 4)]
