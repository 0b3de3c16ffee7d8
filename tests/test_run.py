import json

import pytest

from strandloom.plans.run import main, run
from strandloom.sources import readers


def config(tmp_path, chrom, **own):
    wins = [(f"chr{chrom}", i * 1000, i * 1000 + 1000) for i in range(30)]
    (tmp_path / f"mod{chrom}.bed").write_text("".join(f"{c}\t{s}\t{e}\t{0 if i == 3 else 1}\n" for i, (c, s, e) in enumerate(wins)))
    (tmp_path / f"nd{chrom}.bed").write_text("".join(f"{c}\t{s}\t{e}\t{0 if i == 3 else 0.5}\n" for i, (c, s, e) in enumerate(wins)))
    head = "#CHROM\tPOS\tREF\tALT\tAncestral\tND\tEU\tNA\tAF\tm_1\tm_2\n"
    rows = [f"{chrom}\t{500 + 1000 * (i % 30)}\tA\tG\tA\t{{A}}\t{{{'AG'[i % 2]}}}\t{{A,G}}\t{{A}}\tG\t{'GA'[i % 3 == 0]}\n" for i in range(60)]
    (tmp_path / f"sites{chrom}.tsv").write_text(head + "".join(rows))
    (tmp_path / "gaps").write_text(f"chr{chrom} 10000 12000\n")
    p = {"mutation": 1.25e-8, "window_length": 1000, "generation_time": 29, "rr": 1e-8, "t_introgression_c": 56000, "t_n_c": 640000, "t_af_c": 100000, "t_ea_c": 40000, "t_mexicans_c": 15000, "t_introgression": 55000, "t_mexicans": 500, "admixture_modern": [0.45, 0.5, 0.05], "admixture_nd": 0.025, **own}
    cfg = {"CHROM": str(chrom), "prefix": str(tmp_path), "data": f"sites{chrom}.tsv", "gaps": str(tmp_path / "gaps"), "window_callability": {"Thousand_genomes": f"mod{chrom}.bed", "Nd_1k_genomes": f"nd{chrom}.bed"}, "parameters_initial": p}
    (tmp_path / f"c{chrom}.json").write_text(json.dumps(cfg))
    return str(tmp_path / f"c{chrom}.json")


def covered(rows):
    return {(r.CHROM, r.Sample): sum(x.Length for x in rows if (x.CHROM, x.Sample) == (r.CHROM, r.Sample)) for r in rows}


def test_both_runs(spark, tmp_path):
    paths = [config(tmp_path, 1), config(tmp_path, 2)]
    for em in (True, False):
        rows = run(spark, paths, em=em, steps=3).collect()
        assert covered(rows) == {(f"chr{c}", h): 28000 if c == 2 else 30000 for c in (1, 2) for h in ("m_1", "m_2")}
        assert all(r.Length == r.End - r.Start + 1 for r in rows)


def test_command(spark, tmp_path):
    main(["run.with.EM", "-jsons", config(tmp_path, 1), "-out", str(tmp_path / "out"), "-steps", "2", "-threads", "3"])
    assert readers.segments(spark, str(tmp_path / "out"), True).where("state <> 'UNINFORMATIVE'").count() > 0


def test_each_configuration_keeps_its_parameters(spark, tmp_path):
    """Two unlike configurations together give what each gives alone."""
    paths = [config(tmp_path, 1), config(tmp_path, 2, t_ea_c=100, t_mexicans_c=900000)]
    alone = [sorted(map(tuple, run(spark, [p], em=False).collect())) for p in paths]
    assert sorted(map(tuple, run(spark, paths, em=False).collect())) == sorted(alone[0] + alone[1])
    changed = run(spark, [config(tmp_path, 2)], em=False).collect()
    assert sorted(map(tuple, changed)) != alone[1]


def test_options_of_a_fitted_run(spark, tmp_path):
    """Blocks, refitted transitions and a kept state; another run's folder is refused."""
    args = ["-out", str(tmp_path / "out"), "-steps", "2", "-block", "7", "-refit", "-state", f"file://{tmp_path}/state"]
    main(["run.with.EM", "-jsons", config(tmp_path, 1), *args])
    first = sorted(map(tuple, readers.segments(spark, str(tmp_path / "out"), True).collect()))
    main(["run.with.EM", "-jsons", config(tmp_path, 1), *args])
    assert first and first == sorted(map(tuple, readers.segments(spark, str(tmp_path / "out"), True).collect()))
    with pytest.raises(ValueError, match="another run"):
        main(["run.with.EM", "-jsons", config(tmp_path, 2), *args])
    main(["run", "-json", config(tmp_path, 1), "-out", str(tmp_path / "plain"), "-block", "7"])
    assert readers.segments(spark, str(tmp_path / "plain"), True).count() > 0
