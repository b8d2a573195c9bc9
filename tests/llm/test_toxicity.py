import random

from palisade.llm import toxicity
from tests.llm.common import TEXTS, documents, empty


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinorstlhd") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(rng.randint(2, 5)):
                body.insert(rng.randrange(len(body)), rng.choice(["zzgrumpk", "quaxlorb", "vexhound"]))
        out.append((i, " ".join(body), y))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(900, 5)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels), score_col="__s").withColumnRenamed("__s", "p").selectExpr("doc_id", "p as score").collect()}
    held = [(scored[i] >= 0.5, y) for i, _, y in rows if not i % 3]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.95


def test_edges(spark):
    model = toxicity.fit([(t, y) for _, t, y in corpus(200, 6)])
    df = documents(spark)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert set(df.columns) - {"score"} <= set(rows[0].asDict())
    assert toxicity.score(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(df, none).score("anything") < 1e-9
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.learn(df, one).score("anything") > 0.99


def test_windows_cover_the_whole_text():
    for text in ("", "a", "word " * 1000, "x" * 5000, "é" * 500):
        assert b"".join(toxicity.windows(text)) == text.lower().encode()


def test_each_document_teaches_once(spark):
    rows = corpus(300, 9)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = toxicity.learn(docs, labels)
    other = labels.unionByName(spark.createDataFrame([(7_000, 0), (7_000, 1)], "doc_id long, toxic int"))
    more = docs.unionByName(docs).unionByName(documents(spark, [(7_000, "both classes"), (rows[0][0], "~ a later text")]))
    assert toxicity.learn(more, other).__getstate__() == once.__getstate__()
