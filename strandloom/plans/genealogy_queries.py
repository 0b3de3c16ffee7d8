"""Queries of a genealogy: customers are nodes, younger the larger their number; orders are migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import genealogy
from strandloom.plans.domain import table

#: Length of the sequence, and the times of the two migrations by the share of nodes that are older.
LENGTH, YOUNG, OLD = 10_000, 8, 50
#: Where a node's two edges meet.
CUT = "(c_custkey * 7919) % 9000 + 500"


def tables(s, d):
    nodes = table(s, d, "customer").select("c_custkey")
    count = nodes.agg(F.max("c_custkey").alias("n"))
    timed = nodes.crossJoin(F.broadcast(count)).select("c_custkey", "n", (F.col("n") - F.col("c_custkey")).cast("double").alias("time"))
    cut = F.expr(CUT)
    both = F.array(F.struct(F.expr("c_custkey div 2").alias("parent"), F.lit(0).cast("long").alias("s"), cut.alias("e")), F.struct(F.expr("c_custkey div 3").alias("parent"), cut.alias("s"), F.lit(LENGTH).cast("long").alias("e")))
    edges = timed.select(F.col("c_custkey").alias("child"), F.explode(both).alias("x")).select("child", "x.*").where("parent > 0")
    at = F.when(F.col("o_orderstatus") == "P", F.col("n") - F.expr(f"n div {OLD}")).otherwise(F.col("n") - F.expr(f"n div {YOUNG}")).cast("double")
    start = F.expr("(o_orderkey * 31) % 9000")
    moves = table(s, d, "orders").crossJoin(F.broadcast(count)).select(F.col("o_custkey").alias("node"), F.when(F.col("o_orderstatus") == "P", "ND").when(F.col("o_orderkey") % 3 == 0, "EU").when(F.col("o_orderkey") % 3 == 1, "NA").otherwise("AF").alias("dest"), at.alias("time"), start.alias("s"), (start + 400).alias("e"))
    n = count.first()[0] or 0
    targets = [("ND", "ND", n - n // OLD), *[(x, x, n - n // YOUNG) for x in ("EU", "NA", "AF")]]
    samples = timed.select(F.col("c_custkey").alias("sample"), F.col("c_custkey").alias("node"))
    return samples, edges, timed.select(F.col("c_custkey").alias("node"), "time"), moves, targets


def migrant_tracts(s, d):
    return genealogy.migrant_tracts(*tables(s, d), LENGTH)


def true_states(s, d):
    return genealogy.five_states(genealogy.migrant_tracts(*tables(s, d), LENGTH))


QUERIES = {f.__name__: f for f in (migrant_tracts, true_states)}


def _walk_sql() -> str:
    isl = """SELECT sample, label, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= top THEN 0 ELSE 1 END) OVER (PARTITION BY sample, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, max(e) OVER (PARTITION BY sample, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM hit)) GROUP BY sample, label, g"""
    return f"""RECURSIVE cn AS (SELECT max(c_custkey) AS n FROM customer), nd AS (SELECT c_custkey AS node, (n - c_custkey)::DOUBLE AS time, n FROM customer, cn),
ed AS (SELECT c_custkey AS node, c_custkey // 2 AS parent, 0 AS s, {CUT} AS e FROM customer WHERE c_custkey >= 2 UNION ALL SELECT c_custkey, c_custkey // 3, {CUT}, {LENGTH} FROM customer WHERE c_custkey >= 3),
mg AS (SELECT o_custkey AS node, CASE WHEN o_orderstatus = 'P' THEN 'ND' WHEN o_orderkey % 3 = 0 THEN 'EU' WHEN o_orderkey % 3 = 1 THEN 'NA' ELSE 'AF' END AS label, (CASE WHEN o_orderstatus = 'P' THEN n - n // {OLD} ELSE n - n // {YOUNG} END)::DOUBLE AS at, (o_orderkey * 31) % 9000 AS s, (o_orderkey * 31) % 9000 + 400 AS e FROM orders, cn),
w AS (SELECT node AS sample, node, time AS born, '-infinity'::DOUBLE AS before, time, 0::BIGINT AS s, {LENGTH}::BIGINT AS e, n FROM nd WHERE time <= n - n // {OLD} + 1e-5
  UNION SELECT w.sample, ed.parent, w.born, w.time, nd.time, greatest(w.s, ed.s), least(w.e, ed.e), w.n FROM w JOIN ed ON ed.node = w.node AND ed.s < w.e AND w.s < ed.e JOIN nd ON nd.node = ed.parent WHERE w.time < w.n - w.n // {OLD} - 1e-5),
hit AS (SELECT w.sample, mg.label, greatest(w.s, ed.s, mg.s) AS s, least(w.e, ed.e, mg.e) AS e FROM w JOIN ed ON ed.node = w.node JOIN mg ON mg.node = w.node WHERE greatest(w.s, ed.s, mg.s) < least(w.e, ed.e, mg.e) AND w.before < mg.at - 1e-5 AND w.born <= mg.at + 1e-5),
tr AS ({isl})"""


def oracles() -> dict[str, str]:
    cut = lambda x: f"SELECT b.sample, greatest(b.s, m.s) AS s, least(b.e, m.e) AS e, 'ND_{x}' AS state FROM tr b JOIN tr m ON b.sample = m.sample AND b.label = '{x}' AND m.label = 'ND' AND b.s < m.e AND m.s < b.e"
    rest = lambda x: f"""SELECT sample, s, e, '{x}' AS state FROM (SELECT b.sample, unnest(list_concat([b.s], hs.es)) AS s, unnest(list_concat(hs.ss, [b.e])) AS e FROM tr b LEFT JOIN
  (SELECT b.sample, b.s, list(greatest(b.s, m.s) ORDER BY m.s) AS ss, list(least(b.e, m.e) ORDER BY m.s) AS es FROM tr b JOIN tr m ON b.sample = m.sample AND b.label = '{x}' AND m.label = 'ND' AND b.s < m.e AND m.s < b.e GROUP BY b.sample, b.s) hs
  ON hs.sample = b.sample AND hs.s = b.s WHERE b.label = '{x}') WHERE s < e"""  # noqa: E731
    return {
        "migrant_tracts": f"WITH {_walk_sql()} SELECT * FROM tr",
        "true_states": f"WITH {_walk_sql()} {cut('EU')} UNION ALL {rest('EU')} UNION ALL {cut('NA')} UNION ALL {rest('NA')} UNION ALL SELECT sample, s, e, 'AF' FROM tr WHERE label = 'AF'",
    }
