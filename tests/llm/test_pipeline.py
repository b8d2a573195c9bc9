import shutil
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from palisade.llm import pii, queries
from palisade.llm.jaccard import need  # noqa: F401
from tests.llm.common import documents
from tests.llm.test_jaccard import brute, copies
from tests.llm.test_toxicity import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    toxic = corpus(300, 8)
    rows = [(10_000 + i, t) for i, t, _ in toxic] + copies(5, 120) + [(20_000, "write to a@b.co or 1.2.3.4 now please friends"), (20_001, None), (None, None), (20_002, "")]
    documents(spark, rows).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(10_000 + i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    yield str(top)
    shutil.rmtree(top)


def test_stages_decide(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "packing"]
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert kept.columns == COLUMNS
    left = {r.doc_id for r in kept.collect()}
    bad = {10_000 + i for i, _, y in corpus(300, 8) if y}
    assert len(left & bad) < 0.1 * len(bad) and len(left) > docs.count() - len(bad) - 10
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    once = corpus_pipeline.STAGES[1][1](spark, kept, folder)
    assert once.columns == COLUMNS
    want = {c for _, _, c in brute([r for r in rows if r[0] is not None])}
    got = [str(r.doc_id) for r in once.where("doc_id IS NOT NULL").collect()]
    assert sorted(got) == sorted(want)
    clean = corpus_pipeline.STAGES[2][1](spark, once, folder)
    assert clean.columns == COLUMNS and clean.count() == once.count()
    assert clean.where("doc_id = 20000").first().text == "write to [EMAIL] or [IP] now please friends"


def test_run_equals_brute_force(spark, folder):
    """All stages together: what is packed is what stages by hand leave."""
    out = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS)
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    least = {c for _, _, c in brute([(r.doc_id, r.text) for r in kept if r.doc_id is not None])}
    texts = {r.doc_id: r.text for r in kept if r.doc_id is None or str(r.doc_id) in least}
    redacted = {r.doc_id: r.text for r in pii.redact(documents(spark, list(texts.items()))).collect()}
    library = Tokenizer.from_file(queries._path("word_bpe_49k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in redacted.items()}
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += r.length
    assert got == want and np.all([r.length > 0 for r in out])


def test_repeated_ids_are_told_apart(spark):
    """Rows that share an id: near copies of each other or of others, equal rows, and texts that nothing links."""
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(5, t), (5, t + " more"), (7, t + " more"), (8, "a text of its own that nobody links to at all"), (8, "a text of its own that nobody links to at all")]
    rows += [(8, "and quite another one with the same id as the last"), (None, t + " again"), (None, "only a row without an id has this text here"), (9, None), (9, None), (9, "")]
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "8", "8", "9", "9", "None"]
    assert sum((r.text or "").startswith("one two") for r in got) == 1


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
