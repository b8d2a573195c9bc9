"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import collections
import math

import duckdb
import pytest

from palisade.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLE_SQL:
        return
    cur = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in columns]
    got = collections.Counter(tuple(plain(r[i]) for i in at) for r in rows)
    assert got == collections.Counter(tuple(plain(v) for v in r) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["finding_fingerprint", "hash_chain_check", "debt_delta"])
def test_order_and_partitions_change_nothing(spark, name, tmp_path):
    """Rows shuffled over one or eight files give the same result."""
    results = []
    for n in (1, 8):
        folder = f"{tmp_path}/{n}"
        for t in ("documents", "events"):
            spark.read.parquet(f"{FOLDER}/{t}.parquet").orderBy("doc_id" if t == "documents" and n == 1 else ("event_id" if n == 1 else spark_rand())).repartition(n).write.parquet(f"{folder}/{t}.parquet")
        results.append(sorted(map(str, QUERIES[name](spark, folder).collect())))
    assert results[0] == results[1]


def spark_rand():
    from pyspark.sql import functions as F

    return F.rand(7)
