"""Queries over the star-schema tables: graphs, intervals, versions, look-alikes, hot spots."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from palisade.functions import scalars
from palisade.operators import governance, graphs, matching, packages, similarity
from palisade.plans.registry import query


@query("WITH d AS (SELECT 's' || l_suppkey AS node, NULL AS i, l_partkey AS o FROM lineitem UNION ALL SELECT 'p' || l_partkey, l_suppkey, NULL FROM lineitem) SELECT node, count(DISTINCT i) AS fan_in, count(DISTINCT o) AS fan_out FROM d GROUP BY node")
def fan_in_out(spark, tables):
    """Degrees of the supplier to part graph."""
    e = tables("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graphs.degrees(e)


_NEXT = """e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_suppkey <> b.l_suppkey)"""


def _edges(tables):
    """Suppliers of neighbouring lines of an order, over all lines."""
    return _next(tables("lineitem"))


def _next(lines):
    rows = lines.select("l_orderkey", "l_linenumber", "l_suppkey")
    a = rows.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("src"))
    return a.join(rows.withColumnRenamed("l_suppkey", "dst"), ["l_orderkey", "l_linenumber"]).select("src", "dst").where("src <> dst").distinct()


@query(f"WITH {_NEXT}, d AS (SELECT src AS node, NULL AS i, dst AS o FROM e UNION ALL SELECT dst, src, NULL FROM e), g AS (SELECT node, count(DISTINCT i) AS fan_in, count(DISTINCT o) AS fan_out FROM d GROUP BY node) SELECT *, fan_in * fan_out AS product FROM g ORDER BY product DESC, node LIMIT 5")
def hubs(spark, tables):
    return graphs.hubs(_edges(tables))


@query()
def module_cycles(spark, tables):
    """Strongly connected components over all lines; the closure in SQL is too large, so a test holds it against brute force."""
    return graphs.strong_components(_edges(tables))


@query(
    f"""WITH RECURSIVE {_NEXT}, r(start, node, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 3)
SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node"""
)
def reach_depth3(spark, tables):
    """What every supplier reaches in three steps."""
    return graphs.reach(_edges(tables), depth=3)


@query(f"WITH {_NEXT} SELECT src, dst, CAST(src % 4 AS INTEGER) AS src_rank, CAST(dst % 4 AS INTEGER) AS dst_rank, CASE WHEN src % 4 > dst % 4 THEN 'upward' ELSE 'skips' END AS kind FROM e WHERE src % 4 > dst % 4 OR dst % 4 - src % 4 > 1")
def layer_direction(spark, tables):
    """Edges against the order of layers, or over one, over all lines."""
    layers = tables("supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 4).cast("int").alias("rank"))
    return graphs.layer_violations(_edges(tables), layers, skips=True)


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS changes, count(*) AS lines, count(DISTINCT o_orderkey) * count(*) AS heat FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey ORDER BY heat DESC, o_custkey LIMIT 10")
def hotspots(spark, tables):
    """Changes times size, the ten largest; lines are counted per order before the join."""
    n = tables("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    per = tables("orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("changes"), F.sum("n").alias("lines"))
    return per.withColumn("heat", F.col("changes") * F.col("lines")).orderBy(F.col("heat").desc(), "o_custkey").limit(10)


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE length(p_name) >= 5), p AS (SELECT name AS popular FROM n WHERE substr(sha256(name), 1, 1) < '4'),
x AS (SELECT name FROM n WHERE name NOT IN (SELECT popular FROM p))
SELECT name, min(popular) AS popular FROM x JOIN p ON damerau_levenshtein(name, popular) = 1 GROUP BY name"""
)
def typosquat_pairs(spark, tables):
    """Names one edit from a popular one; a quarter of the part names stand for the popular ones."""
    names = tables("part").select(F.col("p_name").alias("name"))
    return similarity.look_alikes(names, names.where(F.substring(F.sha2("name", 256), 1, 1) < "4"))


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) // 86400 AS a, epoch(o_orderdate) // 86400 + 30 + o_orderkey % 200 AS b FROM orders),
p AS (SELECT o_custkey, epoch(o_orderdate) // 86400 + 15 AS day FROM orders),
m AS (SELECT p.o_custkey, p.day, min({'w': s.b - s.a, 'k': s.o_orderkey}) AS best FROM (SELECT DISTINCT * FROM p) p LEFT JOIN s ON s.o_custkey = p.o_custkey AND s.a <= p.day AND p.day <= s.b GROUP BY ALL)
SELECT o_custkey, CAST(day AS BIGINT) AS "at", best.k AS scope FROM m"""
)
def interval_containment(spark, tables):
    """The innermost of a customer's order windows around each point: an equi-join with a range test."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    o = tables("orders").select("o_custkey", "o_orderkey", day.alias("a"))
    spans = o.withColumn("b", F.col("a") + 30 + F.col("o_orderkey") % 200)
    points = o.select("o_custkey", (F.col("a") + 15).alias("at")).distinct()
    return matching.innermost(points, spans, ("o_custkey",), "at", "a", "b", "o_orderkey")


@query(
    """WITH v AS (SELECT p_partkey, p_brand, [p_size, p_partkey % 10] AS version FROM part), n AS (SELECT p_brand, count(DISTINCT version) AS versions, min(version) AS oldest, max(version) AS newest FROM v GROUP BY p_brand)
SELECT p_partkey, n.versions > 1 AS mixed, version < [25, 5] AS below_minimum, version[1] IN (10, 20, 30) AS supported FROM v JOIN n USING (p_brand)"""
)
def version_policy(spark, tables):
    """Versions as arrays: mixed use, a minimum, a supported set."""
    v = tables("part").select("p_partkey", "p_brand", F.array("p_size", (F.col("p_partkey") % 10).cast("int")).alias("version"))
    n = v.groupBy("p_brand").agg(F.countDistinct("version").alias("versions"))
    return v.join(n, "p_brand").select("p_partkey", (F.col("versions") > 1).alias("mixed"), (F.col("version") < F.array(F.lit(25), F.lit(5))).alias("below_minimum"), F.col("version")[0].isin(10, 20, 30).alias("supported"))


@query(
    """WITH p AS (SELECT p_brand AS name, p_partkey, p_size AS v FROM part), r AS (SELECT DISTINCT p_brand AS name, CAST(p_partkey % 40 AS INTEGER) AS introduced, CAST(p_partkey % 40 + 5 AS INTEGER) AS fixed, p_partkey % 7 = 0 AS open FROM part)
SELECT p_partkey, count(*) AS advisories, min(CASE WHEN NOT open THEN fixed END) AS first_fix FROM p JOIN r ON p.name = r.name AND r.introduced <= p.v AND (open OR p.v < r.fixed) GROUP BY p_partkey"""
)
def version_interval_join(spark, tables):
    """Half-open affected ranges, some without a fix; the join is by name with the range as its residue."""
    return _affected(tables("part"), tables("part"))


def _affected(p, advisories):
    r = advisories.select(F.col("p_brand").alias("name"), (F.col("p_partkey") % 40).cast("int").alias("introduced"), (F.col("p_partkey") % 40 + 5).cast("int").alias("fixed"), (F.col("p_partkey") % 7 == 0).alias("open")).distinct()
    hit = p.join(r, (F.col("p_brand") == F.col("name")) & (F.col("introduced") <= F.col("p_size")) & (F.col("open") | (F.col("p_size") < F.col("fixed"))))
    return hit.groupBy("p_partkey").agg(F.count("*").alias("advisories"), F.min(F.when(~F.col("open"), F.col("fixed"))).alias("first_fix"))


@query(
    """WITH a AS (SELECT l_suppkey AS name, l_returnflag AS flag, l_shipdate AS at, l_orderkey, l_linenumber FROM lineitem) SELECT name, count(*) AS n, count(DISTINCT flag) AS flags FROM a GROUP BY name HAVING count(*) >= 5"""
)
def many_queries(spark, tables):
    """Groups with five rows or more."""
    return tables("lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("flags")).where("n >= 5")


@query(
    """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS annotated FROM lineitem GROUP BY l_orderkey), t AS (SELECT sum(annotated) / sum(n) AS r, sum(n) AS total FROM g)
SELECT l_orderkey, n - annotated AS missing FROM g, t WHERE t.total >= 10 AND t.r >= 0.3 AND n - annotated >= 3"""
)
def ratio_gated_files(spark, tables):
    """A project-wide ratio decides whether files are reported at all; the scalar is one row."""
    g = tables("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("annotated"))
    t = g.agg((F.sum("annotated") / F.sum("n")).alias("r"), F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(t)).where("total >= 10 AND r >= 0.3 AND n - annotated >= 3").select("l_orderkey", (F.col("n") - F.col("annotated")).alias("missing"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_counterpart(spark, tables):
    """Rows without a counterpart, as manifests without a lock file."""
    return matching.missing(tables("documents"), tables("labels"), ("doc_id",))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT c.l_orderkey, c.l_linenumber AS check_line, min(u.l_linenumber) AS use_line FROM c JOIN u ON c.l_orderkey = u.l_orderkey AND c.l_suppkey % 10 = u.l_suppkey % 10 AND c.l_linenumber < u.l_linenumber GROUP BY ALL"""
)
def check_then_use(spark, tables):
    """A check, and a later use of the same target in the same scope."""
    rows = tables("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("target"), "l_returnflag")
    c = rows.where("l_returnflag = 'R'").select("l_orderkey", "target", F.col("l_linenumber").alias("check_line"))
    u = rows.where("l_returnflag <> 'R'").select("l_orderkey", "target", F.col("l_linenumber").alias("use_line"))
    return c.join(u, ["l_orderkey", "target"]).where("check_line < use_line").groupBy("l_orderkey", "check_line").agg(F.min("use_line").alias("use_line"))


@query(
    """WITH l AS (SELECT 'v' || p_partkey AS a, 'b' || p_brand || '/' || p_size AS b FROM part)
SELECT a AS advisory, min(a) OVER (PARTITION BY b) AS "group" FROM l"""
)
def merged_aliases(spark, tables):
    """Advisories that share an alias are one group, named by its least member."""
    return _aliases(tables("part"))


def _aliases(parts):
    a = parts.select(F.concat(F.lit("v"), "p_partkey").alias("advisory"), F.array(F.concat(F.lit("~b"), "p_brand", F.lit("/"), "p_size")).alias("aliases"))
    return packages.merged_aliases(a)


@query("SELECT p_partkey, list_filter(string_split(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), ' '), lambda x: x <> '') AS parts FROM part")
def name_parts(spark, tables):
    return tables("part").select("p_partkey", scalars.name_tokens(F.col("p_name")).alias("parts"))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth FROM orders) SELECT o_orderkey, CAST(nth // 2 AS BIGINT) AS block, count(*) OVER (PARTITION BY o_custkey, nth // 2) AS in_block FROM n"""
)
def trial_blocks(spark, tables):
    """Block randomisation: blocks of two within a team; each full block has one row in either arm."""
    from palisade.operators import logs

    b = logs.blocks(tables("orders"), ("o_custkey",), ("o_orderkey",), 42)
    w = Window.partitionBy("o_custkey", "block")
    return b.withColumn("in_block", F.count("*").over(w)).select("o_orderkey", F.col("block").cast("long").alias("block"), "in_block")


@query(
    """WITH a AS (SELECT l_suppkey AS k, list_sort(list_distinct(list(l_partkey))) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_suppkey AS k, list_sort(list_distinct(list(l_partkey))) AS v FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1),
d AS (SELECT k AS l_suppkey, list_sort(list_filter(coalesce(b.v, []), lambda x: NOT list_contains(coalesce(a.v, []), x))) AS added, list_sort(list_filter(coalesce(a.v, []), lambda x: NOT list_contains(coalesce(b.v, []), x))) AS removed FROM a FULL JOIN b USING (k))
SELECT * FROM d WHERE len(added) + len(removed) > 0"""
)
def premise_differences(spark, tables):
    """Recorded and current sets of dependencies: what came and what went."""
    return _differences(tables("lineitem"))


def _differences(rows):
    part = lambda cond: rows.where(cond).groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("v"))
    return governance.set_differences(part("l_linenumber <= 2"), part("l_linenumber >= 2"), "l_suppkey", "v")


@query("SELECT l_returnflag AS area, CASE WHEN bool_or(l_linestatus = 'F' AND l_quantity > 49.5) THEN 'failed' WHEN bool_or(l_linestatus = 'O' AND l_discount > 0.095) THEN 'undeterminable' ELSE 'verified' END AS verdict FROM lineitem GROUP BY 1")
def verdict_fold(spark, tables):
    q = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49.5), "fail").when((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.095), "open").otherwise("pass")
    return governance.verdict(tables("lineitem").select(F.col("l_returnflag").alias("area"), q.alias("result"), F.lit(True).alias("required")), ("area",))
