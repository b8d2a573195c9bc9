"""Queries over whole tables read as projects: names resolved to files, renamed and patched texts, snapshots compared."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from palisade.operators import fragments, lines, reachability, resolve, snapshots
from palisade.operators.graphs import _cut
from palisade.operators.scratch import Scratch
from palisade.plans.registry import query


def _part_paths(tables):
    path = F.concat_ws("/", F.lower(F.regexp_replace("p_brand", "#", "")), F.lower("p_type"), F.concat(F.regexp_replace("p_name", " ", "/"), F.lit(".py")))
    return tables("part").select("p_partkey", path.alias("path"), "p_size")


@query(
    """WITH p AS (
  SELECT p_partkey, lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '/') || '.py' AS path, p_size FROM part
), f AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM p
), l AS (SELECT DISTINCT l_partkey, l_suppkey, 1 + l_linenumber % 3 AS k, CAST(l_quantity AS INTEGER) % 3 AS argc FROM lineitem
), c AS (
  SELECT DISTINCT a.path, 'm' || l_suppkey || '_' || k AS local, array_to_string(list_slice(string_split(replace(b.path, '.py', ''), '/'), -k, -1), '.') AS module, argc
  FROM l JOIN p a ON a.p_partkey = l_partkey JOIN p b ON b.p_partkey = l_suppkey
), hit AS (
  SELECT n.module, f.path AS target, f.parts FROM (SELECT DISTINCT module FROM c) n JOIN f ON '/' || replace(f.path, '.py', '') LIKE '%/' || replace(n.module, '.', '/')
), s AS (
  SELECT m.path, m.module, hit.target, len(list_filter(range(1, len(parts) + 1), lambda k: list_slice(parts, 1, k) = list_slice(string_split(m.path, '/'), 1, k))) AS shared
  FROM (SELECT DISTINCT path, module FROM c) m JOIN hit ON hit.module = m.module
), t AS (SELECT *, max(shared) OVER (PARTITION BY path, module) AS top FROM s
), b AS (SELECT path, module, count(*) AS n, min(target) AS target FROM t WHERE shared = top GROUP BY path, module
), g AS (SELECT DISTINCT path AS target, p_size % 3 AS argc, true AS has FROM p
), r AS (
  SELECT c.path, c.local || '.run' AS callee, c.argc, b.target,
    CASE WHEN b.n IS NULL THEN 'missing' WHEN b.n > 1 THEN 'ambiguous' WHEN g.has IS NULL THEN 'no_function' ELSE 'found' END AS state
  FROM c LEFT JOIN b ON b.path = c.path AND b.module = c.module LEFT JOIN g ON g.target = b.target AND g.argc = c.argc AND b.n = 1
)
SELECT path, callee, argc, CASE WHEN state = 'found' THEN target END AS target, CASE WHEN state = 'found' THEN 'run' END AS function, state FROM r"""
)
def resolved_part_calls(spark, tables):
    """Parts as files below brand and type; each order line imports its supplier's part by one to three parts of the name and calls it."""
    p = _part_paths(tables)
    read = tables("lineitem").select("l_partkey", "l_suppkey", (1 + F.col("l_linenumber") % 3).alias("k"), (F.col("l_quantity").cast("int") % 3).alias("argc"))
    a, b = p.select(F.col("p_partkey").alias("l_partkey"), "path"), p.select(F.col("p_partkey").alias("l_suppkey"), F.regexp_replace("path", r"\.py$", "").alias("other"))
    module = F.replace(F.expr("substring_index(other, '/', -k)"), F.lit("/"), F.lit("."))
    # parts grow with the lines, and their texts are far larger than the file: no side for a driver to broadcast
    c = read.join(a.hint("merge"), "l_partkey").join(b.hint("merge"), "l_suppkey").select(
        "path", F.concat(F.lit("m"), "l_suppkey", F.lit("_"), "k").alias("local"), module.alias("module"), "argc"
    )
    c = Scratch(spark).keep(c)  # read as imports and as calls, which are made distinct there
    imports = c.select("path", F.lit(1).alias("line"), "local", "module", F.lit(None).cast("string").alias("member"))
    calls = c.select("path", F.concat("local", F.lit(".run")).alias("callee"), "argc")
    return resolve.resolve_calls(calls, imports, p.select("path"), p.select("path", F.lit("run").alias("name"), (F.col("p_size") % 3).alias("argc")))


_RENAMES = """l AS (
  SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents
), k AS (SELECT * FROM l WHERE length(line) >= 12
), a AS (SELECT line, min(doc_id) AS old_id FROM k WHERE doc_id % 2 = 0 GROUP BY line HAVING count(*) = 1
), b AS (SELECT line, min(doc_id) AS new_id FROM k WHERE doc_id % 2 = 1 GROUP BY line HAVING count(*) = 1
), v AS (SELECT CAST(old_id AS VARCHAR) AS old_path, CAST(new_id AS VARCHAR) AS new_path, count(*) AS shared FROM a JOIN b ON a.line = b.line GROUP BY ALL
), w AS (
  SELECT *, row_number() OVER (PARTITION BY old_path ORDER BY shared DESC, new_path) AS x, row_number() OVER (PARTITION BY new_path ORDER BY shared DESC, old_path) AS y FROM v
), n AS (SELECT CAST(doc_id AS VARCHAR) AS path, count(*) AS n FROM k GROUP BY doc_id
), r AS (
  SELECT old_path, new_path, shared, CAST(shared AS DOUBLE) / greatest(o.n, m.n) AS similarity
  FROM w JOIN n o ON o.path = old_path JOIN n m ON m.path = new_path WHERE x = 1 AND y = 1 AND CAST(shared AS DOUBLE) / greatest(o.n, m.n) >= 0.5
)"""


def _sides(tables):
    docs = tables("documents").select(F.col("doc_id").cast("string").alias("path"), "text", (F.col("doc_id") % 2).alias("odd"))
    return docs.where("odd = 0").select("path", "text"), docs.where("odd = 1").select("path", "text")


@query(f"WITH {_RENAMES} SELECT * FROM r")
def renamed_documents(spark, tables):
    """Documents of even ids as one snapshot and of odd ids as the next: near copies are renamed files."""
    return lines.renames(*_sides(tables))


@query(
    f"""WITH {_RENAMES} SELECT old_path, new_path, sha256(d.text) AS rebuilt_sha256, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS lines
FROM r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.new_path"""
)
def patched_documents(spark, tables):
    """The patch from each renamed document's lines, applied to its old text; SQL hashes the new text itself."""
    old, new = _sides(tables)
    # named on both sides, and each side's lines four times: found once
    pairs = _cut(lines.renames(old, new)).select(F.struct("old_path", "new_path").alias("pair"), "old_path", "new_path")
    numbered = lambda side, name: side.join(pairs, F.col("path") == F.col(name)).select("pair", F.lit(name[:3]).alias("side"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    both = numbered(old, "old_path").union(numbered(new, "new_path")).withColumn("line", F.col("line") + 1)
    rebuilt = lines.apply_patch(both.where("side = 'old'"), lines.patch(both)).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return rebuilt.select("pair.old_path", "pair.new_path", F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 256).alias("rebuilt_sha256"), F.size("l").cast("long").alias("lines"))


_AFTER = """after AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN l.toxic = 1 THEN text || '!' ELSE text END AS text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) = 1
  UNION ALL SELECT 'b' || item_id, text FROM benchmark
)"""


def _after(tables):
    docs = tables("documents").join(tables("labels"), "doc_id", "left").where(F.coalesce("quality", F.lit(1)) == 1)
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), changed.alias("text")).union(tables("benchmark").select(F.concat(F.lit("b"), "item_id"), "text"))


@query(
    f"""WITH RECURSIVE {_AFTER}, e AS (SELECT sha256(path) AS place, min(sha256(text)) AS digest FROM after GROUP BY path
), d AS (SELECT CASE WHEN count(*) <= 1024 THEN 1 WHEN count(*) <= 16384 THEN 2 WHEN count(*) <= 262144 THEN 3 ELSE 4 END AS depth FROM e
), t(level, prefix, digest, files) AS (
  SELECT depth, place[1:depth], sha256(string_agg(place || ':' || digest, chr(10) ORDER BY place)), count(*) FROM e, d GROUP BY depth, place[1:depth]
  UNION ALL
  SELECT level - 1, prefix[1:level - 1], sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)), CAST(sum(files) AS BIGINT) FROM t WHERE level > 0 GROUP BY level, prefix[1:level - 1]
)
SELECT level, prefix, digest, files FROM t"""
)
def snapshot_tree(spark, tables):
    """All nodes of the hash tree over documents after a change: toxic ones edited, poor ones gone, benchmark items added."""
    after = _after(tables)
    return snapshots.tree(after, snapshots.depth_for(after.count()))


@query(
    f"""WITH {_AFTER} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents) a FULL JOIN after b ON b.path = a.path WHERE a.path IS NULL OR b.path IS NULL OR a.text <> b.text"""
)
def snapshot_changes(spark, tables):
    """Files that differ between documents and their changed state, by descent along differing nodes."""
    before, after = tables("documents").select(F.col("doc_id").cast("string").alias("path"), "text"), _after(tables)
    depth = snapshots.depth_for(before.count())
    return snapshots.difference(before, after, snapshots.tree(before, depth), snapshots.tree(after, depth), depth)


@query(
    """WITH RECURSIVE n AS (
  SELECT l_orderkey AS scope, l_linenumber AS line, min(l_partkey) AS part, min(l_linestatus) AS status, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber
), o AS (
  SELECT *, part % 7 AS name, lead(part % 7) OVER w AS nx, lead(part % 7, 2) OVER w AS nx2, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY scope ORDER BY line)
), e AS (
  SELECT DISTINCT scope, name AS parent, nx AS child, CASE flag WHEN 'R' THEN true WHEN 'A' THEN false ELSE (CASE WHEN status = 'O' THEN false END) END AS dev FROM o WHERE nx IS NOT NULL
  UNION SELECT scope, name, nx2, status = 'O' FROM o WHERE nx2 IS NOT NULL
), roots AS (SELECT scope, name FROM o WHERE k = 1
), told AS (SELECT scope, name, CASE WHEN p_size > 40 THEN true WHEN p_size < 20 THEN false END AS affected FROM o JOIN part ON p_partkey = part
), asked AS (
  SELECT scope, name, CASE WHEN bool_or(affected) THEN true WHEN count(affected) = count(*) THEN false END AS affected FROM told GROUP BY scope, name
), w AS (
  SELECT scope, parent, child, CASE WHEN NOT dev THEN 0 WHEN dev IS NULL THEN 1 ELSE 2 END AS k FROM e
), t(scope, root, name, k, path) AS (
  SELECT scope, name, name, 0, [name] FROM roots
  UNION SELECT t.scope, t.root, w.child, greatest(t.k, w.k), list_append(t.path, w.child) FROM t JOIN w ON w.scope = t.scope AND w.parent = t.name WHERE NOT list_contains(t.path, w.child)
), r AS (
  SELECT a.*, t.root, t.k, t.path, row_number() OVER (PARTITION BY a.scope, a.name ORDER BY t.k, len(t.path), t.root, t.path) AS nth
  FROM asked a LEFT JOIN t ON t.scope = a.scope AND t.name = a.name WHERE affected OR affected IS NULL
)
SELECT scope AS l_orderkey, name, root, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, '>') AS path,
  CASE WHEN coalesce(k, 2) = 2 THEN 'not_affected' WHEN k = 0 AND affected THEN 'affected' ELSE 'under_investigation' END AS status
FROM r WHERE nth = 1"""
)
def vex_of_orders(spark, tables):
    """Orders as lock files: parts by sevens are packages, lines depend on the next ones, large parts are affected."""
    n = tables("lineitem").groupBy(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("line")).agg(
        F.min("l_partkey").alias("part"), F.min("l_linestatus").alias("status"), F.min("l_returnflag").alias("flag")
    )
    w = Window.partitionBy("scope").orderBy("line")
    name = F.col("part") % 7
    o = n.withColumns({"name": name, "nx": F.lead(name).over(w), "nx2": F.lead(name, 2).over(w), "k": F.row_number().over(w)})
    dev = F.when(F.col("flag") == "R", True).when(F.col("flag") == "A", False).when(F.col("status") == "O", False)
    edges = o.where("nx IS NOT NULL").select("scope", F.col("name").alias("parent"), F.col("nx").alias("child"), dev.alias("dev")).union(
        o.where("nx2 IS NOT NULL").select("scope", "name", "nx2", F.col("status") == "O")
    )
    size = tables("part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_size") > 40, True).when(F.col("p_size") < 20, False).alias("affected"))
    found = reachability.vex_statements(o.join(size, "part").select("scope", "name", "affected"), edges, o.where("k = 1").select("scope", "name"))
    return found.select(F.col("scope").alias("l_orderkey"), "name", "root", "depth", F.array_join("path", ">").alias("path"), "status")


_SECRET = r"""token = "([0-9a-f]{16,})\""""


@query(
    f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SECRET}', 1)) AS secret FROM documents
), g AS (SELECT DISTINCT doc_id, substr(secret, i, 8) AS gram FROM (SELECT doc_id, secret, unnest(generate_series(1, length(secret) - 7)) AS i FROM s)
), p AS (
  SELECT doc_id, i - 1 AS a, substr(text, i, 8) AS gram FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 7)) AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM g))
), h AS (SELECT DISTINCT p.doc_id, a, a + 8 AS b FROM p JOIN g ON g.doc_id = p.doc_id AND g.gram = p.gram
), o AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM h
), i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT doc_id, CAST(min(a) AS INTEGER) AS "start", CAST(max(b) AS INTEGER) AS "end" FROM i GROUP BY doc_id, island"""
)
def secret_fragments(spark, tables):
    """Where a document shows eight characters or more of a token that it assigns."""
    docs = tables("documents").select("doc_id", "text")
    secrets = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_SECRET), F.lit(1))).alias("secret"))
    return fragments.fragments(docs, secrets, key="doc_id")
