import zlib
from collections import defaultdict

from palisade.llm.sharding import shard_by_bytes
from tests.llm.common import TEXTS, documents, empty


def test_edges_and_law(spark):
    rows = shard_by_bytes(documents(spark), 5).collect()
    assert len(rows) == len(TEXTS)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(5))


def test_shards_are_contiguous_and_balanced(spark):
    rows = shard_by_bytes(documents(spark, [(i, "x" * (i * 37 % 101)) for i in range(2000)]), 7).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.values()) <= 2 * 109
    order = [r.shard for r in sorted(rows, key=lambda r: r.doc_id)]
    assert order == sorted(order)


def test_one_id_everywhere_and_few_rows(spark):
    rows = shard_by_bytes(documents(spark, [(1, "same")] * 300), 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(75)]
    assert shard_by_bytes(documents(spark, [(1, "a")]), 24).count() == 1
    assert shard_by_bytes(empty(spark), 24).count() == 0
