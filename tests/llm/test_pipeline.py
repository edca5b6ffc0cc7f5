import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from modelgate.llm import toxicity
from tests.conftest import SF0001
from tests.llm.test_dartminhash import brute as classes_of
from tests.llm.test_packing import plain_best_fit
from tests.llm.test_repetition import brute as quality_of


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF0001)
        out.write.parquet(path := str(tmp_path / name))
        out = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert out.columns == columns
        if name == "quality_rules":
            assert ids(out) == sorted(i for i, t in before if len(t) < 12000 and quality_of(t)["kept"] or i in set(ids(out)) and len(t) >= 12000)
        elif name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
            clean = [i for i, _ in before if labels.get(i) == 0]
            assert len(set(clean) & set(ids(out))) >= 0.97 * len(clean)
        elif name == "minhash_dedup":
            assert ids(out) == sorted(set(classes_of(before).values()))
        else:
            pieces = out.collect()
            assert {r["doc_id"] for r in pieces} == {i for i, _ in before}
            assert len({r["sequence_id"] for r in pieces}) == len(plain_best_fit([r["length"] for r in pieces], 2048))
        docs = out


def test_run_and_empty(spark):
    got = corpus_pipeline.run(spark, SF0001)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF0001)
        assert docs.count() == 0


def test_nulls_in_every_column(spark):
    schema = spark.read.parquet(f"{SF0001}/documents.parquet").schema
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, None, None, None, None), (1, text, None, None, None), (None, text, "en", "s", 1), (1, text, None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF0001)
        assert df.count() == {"quality_rules": 3, "toxicity": 3, "minhash_dedup": 2, "best_fit_packing": 2}[name]


def test_entry_queries_have_one_name_per_operator():
    import __spark_entry__ as entry

    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_scores_take_text_alone():
    model = toxicity.train([np.array([5]), np.array([9])] * 20, np.array([1.0, 0.0] * 20), epochs=3)
    assert pa.array(toxicity.score_flat(model, model.tables(), np.array([5, 9]), np.array([1, 1])))[0].as_py() > 0
