import json

import pytest
from table_rows import rows

from strandloom.plans import prepare
from strandloom.plans.run import main
from strandloom.sources import readers

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def vcf(path, names, lines):
    path.write_text(HEAD + "\t".join(names) + "\n" + "".join("\t".join([c, str(p), ".", r, a, ".", "PASS", ".", "GT", *g]) + "\n" for c, p, r, a, *g in lines))
    return str(path)


@pytest.fixture()
def cfg(tmp_path):
    modern = [
        ("chr7", 3, "A", "G", "0|0", "0|0", "0|0", "0|1"),  # kept: G is new to all panels
        ("chr7", 4, "A", "G", "0|1", "0|1", "0|1", "0|1"),  # archaic file lacks the place: its panel is empty
        ("chr7", 5, "A", "GT", "0|0", "0|0", "0|0", "0|1"),  # indel
        ("chr7", 6, "C", "T", "0|1", "0|1", "0|1", "0|1"),  # all panels have both alleles
        ("chr7", 7, "C", "T", "0|0", "0|0", "0|0", ".|."),  # the ingroup has none
        ("chr7", 20, "C", "T", "0|0", "0|0", "0|0", "1|1"),  # beyond the contig
        ("chr8", 3, "A", "G", "0|0", "0|0", "0|0", "1|1"),  # another chromosome
    ]
    archaic = [("7", 3, "A", "C", "0/1"), ("7", 6, "C", "T", "0/1"), ("7", 20, "C", "G", "1/1")]
    files = {
        "1000GP_files": {"vcf": vcf(tmp_path / "m.vcf", ["e1", "n1", "a1", "x1"], modern), "bed": str(tmp_path / "strict.bed")},
        "neand_files": {"one": {"vcf": vcf(tmp_path / "n.vcf", ["nd1"], archaic), "bed": str(tmp_path / "nd1.bed")}, "two": {"vcf": vcf(tmp_path / "o.vcf", ["nd1"], [("7", 4, "A", "T", "1/1")]), "bed": str(tmp_path / "nd2.bed")}},
        "ancestral": {"fasta": str(tmp_path / "anc.fa")}, "chr_lengths": str(tmp_path / "sizes"),
    }
    (tmp_path / "anc.fa").write_text(">ANC:7:1\nttAAACCtt\n")
    (tmp_path / "sizes").write_text("chr7\t2500\nchr8\t100\n")
    (tmp_path / "strict.bed").write_text("chr7\t0\t500\nchr7\t400\t1500\n")
    (tmp_path / "nd1.bed").write_text("chr7\t0\t3\nchr7\t5\t100\n")
    (tmp_path / "nd2.bed").write_text("chr7\t1400\t2600\n")
    out = {"CHROM": "7", "prefix": str(tmp_path), "data": "sites.tsv", "files": files, "window_callability": {"Thousand_genomes": "mod.bed", "Nd_1k_genomes": "nd.bed"},
           "samples": {"Europeans": ["e1", "gone"], "Americans": ["n1"], "Africans": ["a1"], "Mexicans": ["x1"]}}
    (tmp_path / "c.json").write_text(json.dumps(out))
    return out


def test_sites(spark, cfg, tmp_path):
    main(["main.prep", "-json", str(tmp_path / "c.json")])
    got = readers.sites(spark, prepare.placed(cfg, cfg["data"]))
    assert got.columns == ["chrom", "pos", "ref", "alt", "anc", "ND", "EU", "NA", "AF", "x1_1", "x1_2"]
    assert rows(got) == [
        ("chr7", 19, "C", "G,T", ".", "{G}", "{C}", "{C}", "{C}", "T", "T"),
        ("chr7", 2, "A", "C,G", "A", "{A,C}", "{A}", "{A}", "{A}", "A", "G"),
        ("chr7", 3, "A", "G", "A", ".", "{A,G}", "{A,G}", "{A,G}", "A", "G"),
    ]


def test_callability(spark, cfg, tmp_path):
    main(["callability", "-json", str(tmp_path / "c.json")])
    both = readers.exposures(spark, prepare.placed(cfg, "mod.bed"), prepare.placed(cfg, "nd.bed"))
    assert rows(both) == [("chr7", 0, 0, 1000, 1.0, 0.098), ("chr7", 1, 1000, 2000, 0.5, 0.1), ("chr7", 2, 2000, 2500, 0.0, 0.0)]


def test_contigs():
    assert readers.contig_of(["x"], "chr9") == "x" and readers.contig_of(["a", "ANC:21:1"], "chr21") == "ANC:21:1" and readers.contig_of(["chr2", "chr21"], "21") == "chr21"
    with pytest.raises(ValueError):
        readers.contig_of(["chr2", "chr3"], "X")
