"""Stand-ins for the engine's tables, taken from the driver's: the same rows in Spark and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.hmm_params import Transitions
from strandloom.operators import hmm, intervals

DAY, HOUR = 86_400, 3_600
#: Event types whose events begin covered stretches, modern and ancient, and how many seconds those last.
MODERN, ANCIENT = ("signup", 3_600), ("purchase", 2_400)
#: Event types by the state or panel that they stand for.
PANEL_OF = {"click": "o_eu", "view": "o_na", "purchase": "o_af", "error": "o_nd"}
STATE_OF = {"click": "EU", "error": "ND_EU", "view": "NA", "signup": "ND_NA", "purchase": "AF"}
RATES = np.array([0.2, 0.5, 0.6, 0.9, 1.4])
TRANS = Transitions(ti=1500, tmex=400, rr=2e-6, a=0.4, b=0.45, c1=0.05, c2=0.04, width=1000)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, chrom, hap, pos, event_type, value, state."""
    state = F.create_map(*[F.lit(x) for kv in STATE_OF.items() for x in kv])
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("chr"), F.col("user_id") % 3 + 1).alias("chrom"), F.col("user_id").alias("hap"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', ts)").alias("pos"), "event_type", "value", F.element_at(state, F.col("event_type")).alias("state"),
    )


EVENTS = (
    "ev AS (SELECT event_id, 'chr' || (user_id % 3 + 1) AS chrom, user_id AS hap, date_diff('second', TIMESTAMP '2024-01-01', ts) AS pos, event_type, value, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF.items())
    + " END AS state FROM events)"
)


def lengths(spark: SparkSession, d: str) -> DataFrame:
    """chrom, length: whole days that its events span."""
    return events(spark, d).groupBy("chrom").agg(F.expr(f"(max(pos) div {DAY} + 1) * {DAY}").alias("length"))


LENGTHS = f"lens AS (SELECT chrom, (max(pos) // {DAY} + 1) * {DAY} AS length FROM ev GROUP BY chrom)"
WINDOWS = f"wins AS (SELECT chrom, w AS win, w * {DAY} AS s, w * {DAY} + {DAY} AS e FROM lens, LATERAL (SELECT unnest(range(length // {DAY})) AS w))"


def covered(spark: SparkSession, d: str, event_type: str, seconds: int) -> DataFrame:
    """Intervals of so many seconds from each event of a type: chrom, s, e."""
    return events(spark, d).where(F.col("event_type") == event_type).select("chrom", F.col("pos").alias("s"), (F.col("pos") + seconds).alias("e"))


def exposure(spark: SparkSession, d: str) -> DataFrame:
    """chrom, win, s, e, l_mod, l_anc: covered share of each day, modern and ancient."""
    size = lengths(spark, d)
    shares = [intervals.coverage(intervals.clip(intervals.merge(covered(spark, d, *r), ["chrom"]).join(size, "chrom"), 0, F.col("length")).drop("length"), size, ["chrom"], DAY) for r in (MODERN, ANCIENT)]
    return shares[0].withColumnRenamed("frac", "l_mod").join(shares[1].select("chrom", "win", F.col("frac").alias("l_anc")), ["chrom", "win"])


def _share_sql(name: str, event_type: str, seconds: int) -> str:
    """Covered share of each window, from merged intervals."""
    return f"""
{name}_i AS (SELECT chrom, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= top THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT chrom, pos AS s, pos + {seconds} AS e, max(pos + {seconds}) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM ev WHERE event_type = '{event_type}')) GROUP BY chrom, g),
{name} AS (SELECT w.chrom, w.win, coalesce(sum(least(i.e, w.e) - greatest(i.s, w.s)) FILTER (WHERE i.s IS NOT NULL), 0)::DOUBLE / {DAY} AS frac
  FROM wins w LEFT JOIN {name}_i i ON i.chrom = w.chrom AND i.s < w.e AND w.s < i.e GROUP BY w.chrom, w.win)"""


EXPOSURE = ", ".join([EVENTS, LENGTHS, WINDOWS, _share_sql("lm", *MODERN), _share_sql("la", *ANCIENT), "ex AS (SELECT w.*, lm.frac AS l_mod, la.frac AS l_anc FROM wins w JOIN lm USING (chrom, win) JOIN la USING (chrom, win))"])


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Dense counts of each haplotype and window: chrom, hap, win, s, e, o_eu, o_na, o_af, o_nd, l_mod, l_anc."""
    ev = events(spark, d)
    sums = ev.groupBy("chrom", "hap", F.expr(f"pos div {DAY}").alias("win")).agg(*[F.count_if(F.col("event_type") == t).alias(o) for t, o in PANEL_OF.items()])
    grid = ev.select("chrom", "hap").distinct().join(exposure(spark, d), "chrom")
    return grid.join(sums, ["chrom", "hap", "win"], "left").fillna(0, list(PANEL_OF.values())).select("chrom", "hap", "win", "s", "e", *PANEL_OF.values(), "l_mod", "l_anc")


COUNTS = EXPOSURE + (
    ", haps AS (SELECT DISTINCT chrom, hap FROM ev), obs AS (SELECT h.chrom, h.hap, x.win, x.s, x.e, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {o}" for t, o in PANEL_OF.items())
    + f", x.l_mod, x.l_anc FROM haps h JOIN ex x USING (chrom) LEFT JOIN ev ON ev.hap = h.hap AND ev.chrom = h.chrom AND ev.pos // {DAY} = x.win GROUP BY ALL)"
)


def zeroed(spark: SparkSession, d: str) -> DataFrame:
    return hmm.zero_uncovered(counts(spark, d))


ZEROED = COUNTS + ", z AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN {'l_anc' if o == 'o_nd' else 'l_mod'} > 0 THEN {o} ELSE 0 END AS {o}" for o in hmm.OBS) + ") FROM obs)"


def emission_sql(source: str, extra: str = "", rate=lambda r: f"{float(RATES[r])!r}::DOUBLE") -> str:
    """SELECT of source with e0 to e4; rate gives the SQL of each of RATES."""
    cell = lambda o, r: f"(CASE WHEN {hmm._exposure(o)} > 0 THEN {o} * ln({rate(r)}) - {rate(r)} * {hmm._exposure(o)} ELSE 0 END)"
    cols = [" + ".join(cell(o, r) for o, r in zip(hmm.OBS, panel, strict=True)) + f" AS e{s}" for s, panel in enumerate(hmm.PANELS)]
    return f"SELECT chrom, hap, win, s, e, {', '.join(hmm.OBS)}, l_mod, l_anc, {', '.join(cols)}{extra} FROM {source}"


def matrix_sql(log: bool = True) -> str:
    m = TRANS.log_matrix()
    m = m if log else np.exp(m)
    return "tr(p, q, v) AS (VALUES " + ", ".join(f"({p}, {q}, {float(m[p, q])!r}::DOUBLE)" for p in range(5) for q in range(5)) + ")"


#: Best path of each haplotype by recursion over windows; of equal scores the lowest state.
PATHS = (
    "RECURSIVE "
    + ZEROED
    + ", em AS ("
    + emission_sql("z")
    + "), el AS (SELECT chrom, hap, win, unnest([0, 1, 2, 3, 4]) AS q, unnest([e0, e1, e2, e3, e4]) AS sc FROM em), "
    + matrix_sql()
    + """,
fw AS (SELECT chrom, hap, win, q, sc - ln(5) AS v, NULL::INTEGER AS p FROM el WHERE win = 0
  UNION ALL
  SELECT chrom, hap, win, q, v + sc, p FROM (
    SELECT el.chrom, el.hap, el.win, el.q, el.sc, fw.v + tr.v AS v, fw.q AS p, row_number() OVER (PARTITION BY el.chrom, el.hap, el.q ORDER BY fw.v + tr.v DESC, fw.q) AS r
    FROM fw JOIN el ON el.chrom = fw.chrom AND el.hap = fw.hap AND el.win = fw.win + 1 JOIN tr ON tr.p = fw.q AND tr.q = el.q) WHERE r = 1),
tail AS (SELECT chrom, hap, win, q FROM (SELECT *, row_number() OVER (PARTITION BY chrom, hap ORDER BY win DESC, v DESC, q) AS r FROM fw) WHERE r = 1),
bt AS (SELECT chrom, hap, win, q FROM tail UNION ALL
  SELECT fw.chrom, fw.hap, bt.win - 1, fw.p FROM bt JOIN fw ON fw.chrom = bt.chrom AND fw.hap = bt.hap AND fw.win = bt.win AND fw.q = bt.q WHERE bt.win > 0),
path AS (SELECT bt.chrom, bt.hap, bt.win, z.s, z.e, CASE WHEN z.l_mod = 0 AND z.l_anc = 0 THEN -1 ELSE bt.q END AS state FROM bt JOIN z USING (chrom, hap, win))"""
)


def path(spark: SparkSession, d: str) -> DataFrame:
    """chrom, hap, win, s, e, state: decoded from the counts."""
    return hmm.decode(hmm.pack(zeroed(spark, d), ["chrom", "hap"]), ["chrom", "hap"], RATES, TRANS.log_matrix())


def days(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Intervals of days by supplier: k, s, e, f, st."""
    day = "timestampdiff(DAY, timestamp_ntz'1995-01-01', l_shipdate)"
    return table(spark, d, "lineitem").where(where).select(
        F.col("l_suppkey").alias("k"), F.expr(day).alias("s"), F.expr(f"{day} + cast(l_quantity as bigint)").alias("e"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st")
    )


def days_sql(name: str, where: str = "true") -> str:
    day = "date_diff('day', TIMESTAMP '1995-01-01', l_shipdate)"
    return f"{name} AS (SELECT l_suppkey AS k, {day} AS s, {day} + l_quantity::BIGINT AS e, l_returnflag AS f, l_linestatus AS st FROM lineitem WHERE {where})"


def islands_sql(points: str) -> str:
    """Maximal runs of the (k, d) rows of a query."""
    return f"SELECT k, min(d) AS s, max(d) + 1 AS e FROM (SELECT k, d, d - row_number() OVER (PARTITION BY k ORDER BY d) AS g FROM ({points})) GROUP BY k, g"


def each_day(name: str) -> str:
    return f"SELECT DISTINCT k, unnest(range(s, e)) AS d FROM {name}"


def segments(spark: SparkSession, d: str, where: str = "true", shift: int = 0) -> DataFrame:
    """Stretches from each event of a user to the next, by the state of the first: chrom, hap, s, e, state."""
    from pyspark.sql import Window as W

    order = W.partitionBy("chrom", "hap").orderBy("pos", "event_id")
    rows = events(spark, d).where(where).select("chrom", "hap", (F.col("pos") + shift).alias("s"), (F.lead("pos").over(order) + shift).alias("e"), "state")
    return rows.where("s < e")


def segments_sql(name: str, where: str = "true", shift: int = 0) -> str:
    return f"{name} AS (SELECT chrom, hap, pos + {shift} AS s, nxt + {shift} AS e, state FROM (SELECT *, lead(pos) OVER (PARTITION BY chrom, hap ORDER BY pos, event_id) AS nxt FROM ev WHERE {where}) WHERE pos < nxt)"


TRUTH, PRED = ("true", 0), ("true", 1800)


def truth(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, *TRUTH)


def pred(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, *PRED)


TRUTH_PRED = f"{EVENTS}, {segments_sql('t', *TRUTH)}, {segments_sql('p', *PRED)}"
CONFUSION = (
    TRUTH_PRED + ", conf AS (SELECT t.state AS truth_state, p.state AS pred_state, sum(least(t.e, p.e) - greatest(t.s, p.s))::BIGINT AS bp FROM t JOIN p ON t.chrom = p.chrom AND t.hap = p.hap AND t.s < p.e AND p.s < t.e GROUP BY ALL)"
)
