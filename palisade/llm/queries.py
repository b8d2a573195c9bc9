"""The registered queries of this subpackage: each applies its operator to a whole table and derives what is returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.llm import ann, bpe, chat, credentials, html, jaccard, merkle, packing, pii, repair, sharding, topk, toxicity
from palisade.llm.common import cut


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), 24)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.bpe(_read(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), fields=fields)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS) if name in pii.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(_remainder() != 0)
    scored = toxicity.score(documents, toxicity.learn(documents, labels))
    return scored.select(
        "doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    read = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = cut(chat.windows(read.unionByName(own)))  # turns and loss are read back from it
    each = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    turns = (
        chat.read_turns(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "place", "role", "text"))).alias("t"))
        .select(F.col("conv_id").alias("c"), F.size("t").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("t", each), ""), 256).alias("turns_sha256"))
    )
    loss = (
        formatted.select("conv_id", "window", F.length("text").cast("long").alias("chars"), F.array_join(chat.masked(F.col("text"), F.col("loss")), "").alias("target"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "target"))).alias("w"), F.sum("chars").alias("formatted_chars"))
        .withColumn("target", F.array_join(F.transform("w", lambda w: w["target"]), ""))
    )
    return turns.join(loss, F.col("c").eqNullSafe(F.col("conv_id"))).select(
        "conv_id", "n_turns", "turns_sha256", F.length("target").cast("long").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars"
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_read(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    found = repair.digests(repair.repair(repair.damage(conversations))).withColumnRenamed("conv_id", "found_id")
    ids = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def merkle_rows(documents: DataFrame, levels: int = merkle.LEVELS) -> DataFrame:
    """Each document's leaf, roots and proof, and what its proof gives for the tampered document."""
    changed = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(changed))
    found = merkle.manifest(documents.withColumn("__tampered", tampered), keep=["__tampered"], levels=levels)
    found = found.withColumn("folded_root", merkle.folded(F.col("proof"), F.coalesce("__tampered", "leaf")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(_read(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(credentials.KINDS) - 1)
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(credentials.KINDS)]
    return found.select("doc_id", *counts, F.sha2(credentials.listed(base), 256).alias("base_sha256"), credentials.listed(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_chat": op5_chat,
    "op6_ann": op6_ann,
    "op7_jaccard": op7_jaccard,
    "op8_topk": op8_topk,
    "op9_html": op9_html,
    "op10_packing": op10_packing,
    "op11_repair": op11_repair,
    "op12_merkle": op12_merkle,
    "op13_secrets": op13_secrets,
    "pipeline": pipeline,
}



def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, in whole numbers: bit by bit, with the polynomial that zlib and Spark use."""
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: {bit})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {byte}), 4294967295)"


ORACLE_SQL = {
    # levels of hashes by recursion, siblings by their places
    "op12_merkle": f"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS g,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS ahead,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS behind, coalesce({_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS hit
  FROM documents
), l AS (
  SELECT r, doc_id, g, sha256(ahead || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || behind) AS leaf,
    sha256(ahead || coalesce(strlen(CAST(n_chars + CAST(hit AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(hit AS INT)), '-') || behind) AS used
  FROM f
), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
), t(v, g, i, d, n) AS (
  SELECT 0, g, i, leaf, n FROM p
  UNION ALL SELECT v + 1, g, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY v, g, i // 2, n
), s AS (SELECT g, d AS subroot, v AS height, row_number() OVER (ORDER BY CAST(g AS BLOB)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u(v, i, d, n) AS (
  SELECT 0, i, subroot, n FROM s UNION ALL SELECT v + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY v, i // 2, n
), w AS (
  SELECT p.r, t.v, ((p.i >> t.v) & 1) = 1 AS after, t.d FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.i = xor(p.i >> t.v, 1)
  UNION ALL SELECT p.r, s.height + u.v, ((s.i >> u.v) & 1) = 1, u.d FROM p JOIN s ON s.g = p.g JOIN u ON u.n > 1 AND u.i = xor(s.i >> u.v, 1)
), whole AS (SELECT max(v) AS top FROM u
), o(r, v, d, top) AS (
  SELECT p.r, 0, p.used, s.height + whole.top FROM p JOIN s ON s.g = p.g, whole
  UNION ALL SELECT o.r, o.v + 1, sha256(CASE WHEN w.after THEN w.d || o.d ELSE o.d || coalesce(w.d, '') END), o.top
  FROM o LEFT JOIN w ON w.r = o.r AND w.v = o.v WHERE o.v < o.top
), q AS (SELECT r, string_agg(d, '' ORDER BY v) AS d FROM w GROUP BY r)
SELECT p.doc_id, p.leaf, s.subroot, root.d AS root, sha256(coalesce(q.d, '')) AS proof_sha256, o.d AS folded_root, o.d = root.d AS verified
FROM p JOIN s ON s.g = p.g JOIN o ON o.r = p.r AND o.v = o.top LEFT JOIN q ON q.r = p.r, (SELECT d FROM u WHERE n = 1) root
""",
    # all pairs of a query and another row, in whole numbers
    "op8_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    # every pair of documents that shares a shingle, then reachability
    "op7_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i+4], ' ')))) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l
), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
""",
    "op5_chat": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, len(regexp_extract_all(text, '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')) + 4 AS tokens,
    length(role) + length(text) + length(text) - length(replace(text, '\\', '')) + 2 * len(regexp_extract_all(text, '</?s>|\\[/?INST\\]|<</?SYS>>|<\\||\\|>')) + 13 AS chars
  FROM c
), first AS (
  SELECT conv_id, tokens AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM t WHERE role = 'system') WHERE k = 1
), o AS (
  SELECT t.*, greatest(768 - coalesce(s, 0), 256) AS room, row_number() OVER (PARTITION BY t.conv_id ORDER BY turn, role, text) AS place,
    sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - tokens AS before
  FROM t LEFT JOIN first ON first.conv_id = t.conv_id
), x AS (SELECT *, before // room AS cell, before + tokens > (before // room + 1) * room AS crosses FROM o
), filled AS (SELECT conv_id, cell, sum(tokens) AS filled FROM x WHERE NOT crosses GROUP BY conv_id, cell
), p AS (
  SELECT x.*, CASE WHEN NOT crosses OR coalesce(filled, 0) + tokens <= room THEN 2 * x.cell ELSE 2 * x.cell + 1 END AS win, crosses AND tokens > room AS big
  FROM x LEFT JOIN filled ON filled.conv_id = x.conv_id AND filled.cell = x.cell
), spans AS (
  SELECT conv_id, win, max(place) AS last, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS next, lead(bool_or(big)) OVER (PARTITION BY conv_id ORDER BY win) AS full
  FROM p GROUP BY conv_id, win
), systems AS (SELECT conv_id, min(place) AS place FROM p WHERE role = 'system' GROUP BY conv_id
), latest AS (
  SELECT p.conv_id, spans.next AS win, p.place, p.chars, sum(tokens) OVER (PARTITION BY p.conv_id, p.win ORDER BY place DESC ROWS UNBOUNDED PRECEDING) AS upto
  FROM p JOIN spans ON spans.conv_id = p.conv_id AND spans.win = p.win WHERE spans.next IS NOT NULL AND NOT spans.full AND p.place > spans.last - 2
), again AS (
  SELECT conv_id, win, place, chars FROM latest WHERE upto <= 256
  UNION
  SELECT spans.conv_id, spans.win, p.place, p.chars FROM spans JOIN systems ON systems.conv_id = spans.conv_id JOIN p ON p.conv_id = systems.conv_id AND p.place = systems.place WHERE spans.win > p.win
), f AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM p UNION ALL SELECT conv_id, chars FROM again) GROUP BY conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS target
  FROM p GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256, CAST(f.chars AS BIGINT) AS formatted_chars
FROM d JOIN f ON f.conv_id = d.conv_id
""",
    # what an article container holds, for pages as these tables have them
    "op9_html": """
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1) AS body FROM pages
), t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*(?:>|$)', ' ', 'g') AS body FROM a
), u AS (
  SELECT page_id, url, trim(regexp_replace(replace(regexp_replace(replace(replace(body, '&lt;', '<'), '&quot;', '"'), '&amp(;|$)', '&', 'g'), chr(160), ' '), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM t
)
SELECT page_id, url, text, length(text) AS n_chars FROM u
""",
}
