import collections
import hashlib
import random
import zlib

import pytest

from palisade.llm import merkle
from palisade.llm.queries import QUERIES, merkle_rows

from .common import documents, empty

COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """(root, proofs): each proof lists (sibling or None, whether it lies to the left)."""
    at, proofs, level = list(range(len(digests))), [[] for _ in digests], digests
    while len(level) > 1:
        for k, i in enumerate(at):
            other = level[i ^ 1] if i ^ 1 < len(level) else None
            proofs[k].append((other, bool(i & 1)))
        at = [i // 2 for i in at]
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def expected(rows):
    """A counter of rows (doc_id, source, lang, n_chars, text) as the query returns them."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r, digest(*map(said, r))))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        by[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: tree([d for _, d in by[g]]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = collections.Counter()
    for k, g in enumerate(names):
        for (row, leaf), own in zip(by[g], trees[g][1]):
            proof = own + above[k]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = digest(*map(said, (*row[:3], row[3] + 1, row[4]))) if hit else leaf
            for other, left in proof:
                node = digest(*((other, node) if left else (node, other or "")))
            out[row[0], leaf, trees[g][0], root, digest(*(d for d, _ in proof if d)), node, node == root] += 1
    return out


def got(df):
    return collections.Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect())


def write(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(f"{folder}/documents.parquet")


def rows_of(seed, sizes):
    rng, out = random.Random(seed), []
    for lang, n in sizes.items():
        out += [(rng.choice((rng.randint(0, 40), rng.randint(0, 10**6), None)), rng.choice(("web", None, "é")), lang, rng.choice((None, i, 9, 99)), rng.choice((None, "", "tëxt" * i))) for i in range(n)]
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {None: 1, "en": 2}, {"en": 37, "de": 8, None: 5, "": 3, "zh": 1, "Ω": 16}])
def test_query_equals_plain_trees(spark, tmp_path, sizes):
    rows = rows_of(4, sizes) * (2 if len(sizes) > 2 else 1)
    write(spark, rows, tmp_path)
    assert got(QUERIES["op12_merkle"](spark, str(tmp_path))) == expected(rows)


def test_many_blocks_and_partitions(spark, tmp_path):
    """Small blocks: several tiers of them, groups that lie in many partitions, many groups."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = rows_of(8, {"en": 700, "de": 64, "fr": 65, "es": 9} | {f"x{i}": 1 + i % 3 for i in range(40)})
        write(spark, rows, tmp_path)
        assert got(merkle_rows(spark.read.parquet(f"{tmp_path}/documents.parquet"), levels=3)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 257, 1000, 4096])
def test_traversal_equals_whole_trees(n):
    leaves = [digest(str(i)) for i in range(n)]
    for block in (0, 3):
        height = merkle._height(block, n, merkle.LEVELS)
        level, want = leaves, [[] for _ in leaves]
        for j in range(height):
            for t in range(n):
                i = t >> j
                want[t].append("=" if i ^ 1 >= len(level) else "<>"[not i & 1] + level[i ^ 1])
            level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
        assert list(merkle.paths(leaves, height)) == want
        assert merkle.block_root(leaves, height) == level[0]


def test_edges(spark):
    assert merkle.manifest(empty(spark)).count() == 0
    out = merkle.manifest(documents(spark)).collect()
    assert len(out) == 12 and len({r.root for r in out}) == 1 and all(len(r.proof) == 4 for r in out)
