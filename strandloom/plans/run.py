"""Runs from configuration files: observations, exposures, model, tracts, gaps and segment files.

Observations of all configurations are one table keyed by chromosome and haplotype, so any number of files is one job.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.hmm_params import from_config
from strandloom.functions.scalars import chrom_with
from strandloom.operators import em_state, intervals, observe
from strandloom.plans import prepare, scores
from strandloom.plans.pipeline import em_run, fixed_run
from strandloom.sources import readers, writers

KEYS = ["chrom", "hap"]


def observations(spark: SparkSession, cfg: dict, missing: str) -> DataFrame:
    """Counts and exposures of one configuration: (chrom, hap, win, s, e, o_*, l_mod, l_anc)."""
    at = lambda p: prepare.placed(cfg, p)
    masks = cfg["window_callability"]
    width = int(cfg["parameters_initial"]["window_length"])
    raw = readers.sites(spark, at(cfg["data"])).drop("ref", "alt")
    spanned = intervals.make_windows(raw.groupBy("chrom").agg((F.max("pos") + 1).alias("length")), width)
    wins = readers.exposures(spark, at(masks.get("Thousand_genomes")), at(masks.get("Nd_1k_genomes")), missing, spanned)
    chrom = spark.range(1).select(chrom_with(F.lit(str(cfg["CHROM"]))).alias("chrom"))
    wins = wins.join(F.broadcast(chrom), "chrom", "left_semi")
    wide = raw.join(F.broadcast(chrom), "chrom", "left_semi")
    return observe.observations(wide, wins, width).select(*KEYS, "win", "s", "e", "o_eu", "o_na", "o_af", "o_nd", "l_mod", "l_anc")


def run(
    spark: SparkSession, paths: Sequence[str], out: str | None = None, em: bool = True, steps: int = 20, block: int | None = None, refit: bool = False, state: str | None = None
) -> DataFrame:
    """Segments (Sample, CHROM, Start, End, Length, State) of all configurations, written to out if given. With em, rates
    are fitted to all of them together from the parameters of the first; without, each configuration keeps its own:
    those of equal parameters are decoded in one job. block, refit and state: see em_run."""
    configs = [readers.config(spark, p) for p in paths]
    groups: dict[str, list[dict]] = {}
    for c in configs:
        groups.setdefault("" if em else json.dumps(c["parameters_initial"], sort_keys=True), []).append(c)
    if state:
        em_state.guard(spark, f"{state}/configs", json.dumps(configs, sort_keys=True))
    parts = []
    for group in groups.values():
        rates, trans = from_config(group[0]["parameters_initial"])
        counts = reduce(DataFrame.unionByName, [observations(spark, c, "zero" if em else "ones") for c in group])
        gaps = reduce(DataFrame.unionByName, [readers.gaps(spark, c.get("gaps")) for c in group]).distinct()
        width = 100 * int(trans.width)
        if em:
            parts.append(em_run(counts, KEYS, rates, trans, gaps, width, steps, block, refit, state)[0])
        else:
            parts.append(fixed_run(counts, KEYS, rates, trans.log_matrix(), gaps, width, block))
    made = reduce(DataFrame.unionByName, parts)
    made = made.select(F.col("hap").alias("Sample"), F.col("chrom").alias("CHROM"), "Start", "End", "Length", "State")
    if out:
        writers.segments(made, out)
    return made


def main(args: Sequence[str]) -> None:
    """run -json FILE...  |  run.with.EM -jsons FILE... -out FOLDER  |  restrict_1kG -json FILE  |  main.prep -json FILE
    callability -json FILE  |  evaluate -truth FILE -segments FILE... | -decoded FILE... | -msp FILE... -out FOLDER"""
    import argparse

    parser = argparse.ArgumentParser(prog="strandloom", description=main.__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    plain = commands.add_parser("run")
    plain.add_argument("-json", nargs="+", required=True)
    plain.add_argument("-out", default="segments")
    fitted = commands.add_parser("run.with.EM")
    fitted.add_argument("-jsons", nargs="+", required=True)
    fitted.add_argument("-out", default="segments")
    fitted.add_argument("-steps", type=int, default=20)
    fitted.add_argument("-refit", action="store_true", help="fit the transitions too")
    fitted.add_argument("-state", help="folder in which steps are kept and found again")
    for command in (plain, fitted):
        command.add_argument("-block", type=int, help="windows of a block, for haplotypes of very many windows")
    made = {"restrict_1kG": prepare.write_restricted, "main.prep": prepare.write_sites, "callability": prepare.write_callability}
    for name in made:
        commands.add_parser(name).add_argument("-json", required=True)
    scored = commands.add_parser("evaluate")
    scored.add_argument("-truth", nargs="+", required=True, help="several: runs, each with a file of -segments")
    for kind in ("segments", "decoded", "msp"):
        scored.add_argument(f"-{kind}", nargs="+")
    scored.add_argument("-populations", nargs="*", default=[], help="POP=STATE for -msp")
    scored.add_argument("-least", type=float, nargs="*", help="posterior thresholds for -decoded: one scores, several give a table")
    scored.add_argument("-lengths", type=int, nargs="*", help="scores by the length of true segments too; edges of the bins, none: the usual ones")
    scored.add_argument("-out", required=True)
    for command in commands.choices.values():
        command.add_argument("-threads", type=int, help="taken and not used: Spark deals the work to what it runs on")
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    if got.command in made:
        made[got.command](spark, readers.config(spark, got.json))
    elif got.command == "evaluate":
        scores.write(spark, got.truth, got.out, got.segments, got.decoded, got.msp, dict(p.split("=") for p in got.populations), got.least, got.lengths)
    elif got.command == "run":
        run(spark, got.json, got.out, em=False, block=got.block)
    else:
        run(spark, got.jsons, got.out, em=True, steps=got.steps, block=got.block, refit=got.refit, state=got.state)
