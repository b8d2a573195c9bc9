"""Queries over order lines read as programs: an order is a function, its lines are the steps in it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from palisade.operators import flow
from palisade.operators.scratch import Scratch
from palisade.plans.registry import query

_STEPS = """n AS (
  SELECT l_orderkey AS fn, l_linenumber AS slot, min(l_suppkey) AS supp, min(l_partkey) AS part, max(l_discount) AS disc, min(l_returnflag) AS flag, min(l_linestatus) AS status, max(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), o AS (
  SELECT *, lead(slot) OVER w AS nx, lead(slot, 2) OVER w AS nx2, first_value(slot) OVER w AS fst FROM n WINDOW w AS (PARTITION BY fn ORDER BY slot)
)"""


def _steps(lines, **columns):
    """The steps of each order with these columns, the next steps and the first; shuffled once and written, as many inputs are made of them."""
    n = lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("slot")).agg(*(c.alias(k) for k, c in columns.items()))
    w = Window.partitionBy("fn").orderBy("slot")
    return Scratch(n.sparkSession).keep(n.withColumns({"nx": F.lead("slot").over(w), "nx2": F.lead("slot", 2).over(w), "fst": F.first("slot").over(w)}))


@query(
    f"""WITH RECURSIVE {_STEPS}, e AS (
  SELECT fn, slot AS src, nx AS dst FROM o WHERE nx IS NOT NULL UNION SELECT fn, slot, nx2 FROM o WHERE flag = 'R' AND nx2 IS NOT NULL UNION SELECT fn, slot, fst FROM o WHERE flag = 'A'
), d AS (SELECT fn, slot, supp % 3 AS var, disc <= 0.05 AS sure FROM n
), r(fn, var, def, slot) AS (
  SELECT d.fn, d.var, d.slot, e.dst FROM d JOIN e ON e.fn = d.fn AND e.src = d.slot
  UNION
  SELECT r.fn, r.var, r.def, e.dst FROM r LEFT JOIN (SELECT * FROM d WHERE sure) k ON k.fn = r.fn AND k.slot = r.slot AND k.var = r.var
  JOIN e ON e.fn = r.fn AND e.src = r.slot WHERE k.fn IS NULL
)
SELECT n.fn AS l_orderkey, n.slot AS l_linenumber, r.var, r.def FROM n JOIN r ON r.fn = n.fn AND r.slot = n.slot AND r.var = n.part % 3"""
)
def reaching_order_lines(spark, tables):
    """Order lines as a flow graph: flag R also skips a line, flag A goes back to the first; suppliers define, parts use."""
    o = _steps(tables("lineitem"), supp=F.min("l_suppkey"), part=F.min("l_partkey"), sure=F.max("l_discount") <= 0.05, flag=F.min("l_returnflag"))
    edge = lambda to, when: o.where(when).select(F.col("fn").alias("unit"), F.col("slot").alias("src"), F.col(to).alias("dst"))
    steps = edge("nx", "nx IS NOT NULL").union(edge("nx2", "flag = 'R' AND nx2 IS NOT NULL")).union(edge("fst", "flag = 'A'"))
    at = lambda var: (F.col("fn").alias("unit"), F.col("slot").alias("node"), (F.col(var) % 3).alias("var"))
    found = flow.reaching_definitions(steps, o.select(*at("supp"), "sure"), o.select(*at("part")))
    return found.select(F.col("unit").alias("l_orderkey"), F.col("node").alias("l_linenumber"), "var", "def")


@query(
    f"""WITH RECURSIVE {_STEPS}, p AS (
  SELECT o.fn, o.slot, o.nx, CASE WHEN o.flag <> 'R' THEN o.nx END AS go, f.fn AS callee, f.slot AS enter, o.nx IS NULL AS leaves, o.disc >= 0.1 AS source, o.qty > 45 AS sink
  FROM o LEFT JOIN o f ON o.status = 'O' AND f.fn = o.part AND f.slot = f.fst
), t(sf, ss, fn, slot, rising, path, nest) AS (
  SELECT fn, slot, fn, slot, true, [fn], CAST([] AS STRUCT(f BIGINT, s INTEGER)[]) FROM p WHERE source
  UNION (
    SELECT t.sf, t.ss, m.fn, m.slot, t.rising AND NOT coalesce(m.opened, false), CASE WHEN m.opened THEN list_append(t.path, m.fn) ELSE t.path END, m.nest
    FROM (
      SELECT t.*, unnest([
        {{'fn': t.fn, 'slot': p.go, 'opened': false, 'nest': t.nest}},
        {{'fn': CASE WHEN len(t.nest) < 3 AND p.nx IS NOT NULL THEN p.callee END, 'slot': p.enter, 'opened': false, 'nest': list_append(t.nest, {{'f': t.fn, 's': p.nx}})}},
        {{'fn': CASE WHEN len(t.nest) = 0 AND len(t.path) <= 3 THEN p.callee END, 'slot': p.enter, 'opened': true, 'nest': t.nest}},
        {{'fn': CASE WHEN p.leaves THEN t.nest[-1].f END, 'slot': t.nest[-1].s, 'opened': false, 'nest': t.nest[1:len(t.nest) - 1]}}
      ]) AS m FROM t JOIN p ON p.fn = t.fn AND p.slot = t.slot
    ) t WHERE m.fn IS NOT NULL AND m.slot IS NOT NULL
    UNION ALL
    SELECT t.sf, t.ss, c.fn, c.nx, true, list_append(t.path, c.fn), t.nest
    FROM t JOIN p ON p.fn = t.fn AND p.slot = t.slot AND p.leaves JOIN p c ON c.callee = t.fn AND c.nx IS NOT NULL WHERE len(t.nest) = 0 AND t.rising AND len(t.path) <= 3
  )
), h AS (
  SELECT t.sf, t.ss, t.fn, t.slot, t.path, row_number() OVER (PARTITION BY t.sf, t.ss, t.fn, t.slot ORDER BY len(t.path), t.path) AS k
  FROM t JOIN p ON p.fn = t.fn AND p.slot = t.slot AND p.sink WHERE len(t.nest) = 0
)
SELECT sf AS source_fn, ss AS source, fn AS sink_fn, slot AS sink, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM h WHERE k = 1"""
)
def sink_hits_over_orders(spark, tables):
    """Orders as functions: lines hand their value on unless returned; open lines call the order with their part's number."""
    # source and sink are the same of the greatest value as of any, so the values themselves aren't moved
    lines = tables("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.1).alias("source"), (F.col("l_quantity") > 45).alias("sink"))
    o = _steps(
        lines, part=F.min("l_partkey"), flag=F.min("l_returnflag"), status=F.min("l_linestatus"), source=F.bool_or("source"), sink=F.bool_or("sink"),
    )
    first = o.where("slot = fst").select(F.col("fn").alias("callee"))
    calls = o.where("status = 'O'").withColumnRenamed("part", "callee").select("fn", "slot", "nx", "callee").join(first, "callee").withColumn("site", F.struct("fn", "slot"))
    calls = Scratch(spark).keep(calls)
    found = flow.sink_hits(
        flows=o.where("flag <> 'R' AND nx IS NOT NULL").select("fn", F.col("slot").alias("src"), F.col("nx").alias("dst")),
        params=o.where("slot = fst").select("fn", F.lit(0).alias("place"), "slot"),
        returns=o.where("nx IS NULL").select("fn", "slot"),
        args=calls.select("site", "fn", "callee", F.lit(0).alias("place"), "slot"),
        results=calls.where("nx IS NOT NULL").select("site", "fn", "callee", F.col("nx").alias("slot")),
        sources=o.where("source").select("fn", "slot"), sinks=o.where("sink").select("fn", "slot"), limit=3,
    )
    return found.withColumn("path", F.array_join("path", ">"))
