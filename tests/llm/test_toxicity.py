import os
from pathlib import Path

import numpy as np

from modelgate.llm import toxicity as X


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for _ in range(n):
        d = rng.integers(0, 400, rng.integers(0, 60))
        toxic = rng.random() < 0.3
        if toxic:
            d = np.append(d, rng.integers(400, 410, 3))
        docs.append(rng.permutation(d) * X.BUCKETS + d.sum() % 7)
        labels.append(float(toxic))
    return [np.asarray(d, dtype=np.int64) for d in docs], np.array(labels)


def flat(docs):
    return np.concatenate(docs), np.array([len(d) for d in docs], dtype=np.int64)


def test_learns_and_scores_in_pieces():
    docs, y = corpus(900, 1)
    model = X.train(docs, y, epochs=12)
    held, z = corpus(300, 2)
    scores = X.score_flat(model, model.tables(), *flat(held))
    assert ((scores >= 0.5) == (z == 1)).mean() > 0.95
    assert np.allclose(X.score_flat(model, model.tables(), *flat(held), piece=37), scores, atol=1e-6)
    alone = [X.score_flat(model, model.tables(), *flat([d]))[0] for d in held[:40]]
    assert np.allclose(alone, scores[:40], atol=1e-6)


def test_constant_models():
    none = X.train([], np.zeros(0))
    assert none.constant == 0.5
    one = X.train([np.array([1])], np.array([1.0]))
    assert 0.5 < one.constant < 1
    assert X.score_flat(one, {}, *flat([np.array([1]), np.array([], dtype=np.int64)])).tolist() == [one.constant] * 2


def test_fit_score_and_flag(spark):
    rng = np.random.default_rng(3)
    words = [f"plain{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(400):
        t = [words[j] for j in rng.integers(0, 200, 30)]
        toxic = i % 4 == 0
        if toxic:
            t[5], t[9] = "awful", "horrid"
        rows.append((i, " ".join(t), "en" if i % 2 else None, "z"))
        marks.append((i, int(toxic)))
    rows += [(900, None, "en", "z"), (901, "", "xx", "z"), (None, "awful horrid words", "en", "z"), (902, "plain1 " * 40000, "en", "z"), (0, rows[0][1], None, "z")]
    marks += [(0, 1), (None, 1), (5000, 1), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = X.fit(df, labels)
    out = X.score(df, model, keep=["doc_id", "score"])
    assert out.columns == ["doc_id", "score", "score_"]
    got = out.collect()
    assert len(got) == len(rows)
    right = [(r["score_"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean(right) > 0.97
    assert len({r["score_"] for r in got if r["doc_id"] == 0}) == 1
    assert len({r["score_"] for r in got if r["doc_id"] in (900, 901)}) == 1
    flagged = X.flag(df, model)
    assert flagged.columns[:-1] == df.columns
    empty = df.limit(0)
    assert X.score(empty, X.fit(empty, labels.limit(0))).count() == 0


def test_rows_beyond_the_first_are_learned_from_and_calibrate(spark, monkeypatch):
    monkeypatch.setattr(X, "RATE", 0.05)
    rng = np.random.default_rng(5)
    words = [f"plain{i}" for i in range(150)]
    rows, marks = [], []
    for i in range(2400):
        t = [words[j] for j in rng.integers(0, 150, 20)]
        toxic = i % 4 == 0
        if toxic:
            t[5] = t[9] = ("awful", "horrid")[(i // 4) % 2]
        rows.append((i, " ".join(t), "en" if i % 2 else "de"))
        marks.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    used = X.training_rows(df, labels, None, "doc_id", "text", "lang")
    assert used.count() == 2400
    first, rest = X.first_rows(used, 40, 120)
    assert (used.where(first).count(), used.where(rest).count()) == (160, 2240)
    calls, calibrated, refine, exact = [], [], X.refine, X.exact_thresholds
    monkeypatch.setattr(X, "refine", lambda r, m, n: calls.append(r.count()) or refine(r, m, n))
    monkeypatch.setattr(X, "exact_thresholds", lambda s: calibrated.append(s.count()) or exact(s))
    model = X.fit(df, labels, max_toxic=40, max_clean=120)
    # 128 of the first 160 are trained on by the driver, all others by tasks or calibrate
    assert len(calls) == X.ROUNDS and 128 + sum(calls) + calibrated[0] == 2400
    got = X.score(df, model, keep=["doc_id"]).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got]) > 0.97


def test_the_driver_gets_the_model_but_no_rows(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 60, 12)) + " awful" * (i % 3 == 0), "en" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    got = X.training_rows(df, labels, None, "doc_id", "text", "lang").orderBy("order__").collect()
    lists, y = [np.array(r["words__"], dtype=np.int64) + (1 << 31) for r in got], np.array([r["label__"] for r in got], dtype=float)
    held = np.arange(300) % X.CALIBRATION == 0
    want = X.train([lists[i] for i in np.flatnonzero(~held)], y[~held])
    scores = X.score_flat(want, want.tables(), *flat([lists[i] for i in np.flatnonzero(held)]))
    where, train = str(tmp_path / "pids"), X.train

    def told(*args, **kwargs):
        with open(where, "a") as f:
            f.write(f"{os.getpid()}\n")
        return train(*args, **kwargs)

    monkeypatch.setattr(X, "train", told)
    model = X.fit(df, labels)
    pids = Path(where).read_text().split()
    assert len(pids) == 1 and int(pids[0]) != os.getpid()
    assert np.allclose(model.embed, want.embed) and np.allclose(model.out, want.out)
    assert np.isclose(model.threshold, X.threshold_for(scores, y[held])) and set(model.thresholds) == {"en", "None"}


def test_exact_thresholds_equal_the_sorted_ones(spark):
    rng = np.random.default_rng(6)
    rows = [("en" if i % 3 else None, int(i % 7 == 0), float(rng.integers(0, 5000)) / 5000) for i in range(3000)]
    rows += [("xx", 1, 0.9)]
    found = X.exact_thresholds(spark.createDataFrame(rows, "lang__ string, label__ int, score__ double").repartition(5))
    for code in (None, "en", "None", "xx"):
        own = [(lab, s) for lang, lab, s in rows if code is None or (lang or "None") == code]
        lab, s = (np.array(v) for v in zip(*own))
        assert found[code] == (len(own), X.threshold_for(s, lab))
