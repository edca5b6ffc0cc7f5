import numpy as np
import pyarrow as pa

from modelgate.llm import weak_quality as Q
from tests.conftest import SF0001


def test_estimation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    accuracy = np.array([0.95, 0.85, 0.7, 0.9, 0.6])
    votes = np.where(rng.random((20000, 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20000, 5)) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.fit_labels(patterns, counts.astype(float))
    assert np.abs(model.accuracy - accuracy).max() < 0.03
    assert abs(model.share - 0.7) < 0.03
    belief = {tuple(p): b for p, b in zip(patterns.tolist(), model.posterior(patterns), strict=True)}
    right = np.mean([(belief[tuple(v)] >= 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)])
    assert right > 0.9


def test_scores_do_not_depend_on_the_slice():
    texts = ["The cat sat on the mat.", None, "", "A A A A", "ÉTÉ 12 &&& | x" * 50]
    rng = np.random.default_rng(0)
    w = rng.normal(size=Q.BUCKETS)
    whole = Q.score_texts(pa.array(texts), w, 0.1)
    alone = [Q.score_texts(pa.array([t], pa.string()), w, 0.1)[0] for t in texts]
    assert np.allclose(whole, alone) and whole[1] == whole[2] == 0.0


def test_held_out_labels(spark):
    documents = spark.read.parquet(f"{SF0001}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    scored = Q.score(documents, Q.fit(documents), keep=["doc_id"]).collect()
    assert len(scored) == documents.count()
    right = [(r["score"] >= 0.5) == (labels[r["doc_id"]] == 1) for r in scored if r["doc_id"] in labels]
    assert np.mean(right) > 0.9


def test_edge_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "a b c", "s"), (3, "word " * 3000, "s"), (3, "word " * 3000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = Q.score(df, Q.fit(df), keep=["doc_id", "score"])
    assert out.columns == ["doc_id", "score", "score_"]
    got = out.collect()
    assert len(got) == 5 and all(0 <= r["score_"] <= 1 for r in got)
    assert {r["score_"] for r in got if r["doc_id"] in (1, 2)} == {0.0}
    assert len({r["score_"] for r in got if r["doc_id"] == 3}) == 1
    empty = df.limit(0)
    assert Q.score(empty, Q.fit(empty)).count() == 0
