import random

import numpy as np
import pyarrow as pa

from modelgate.llm.common import U64, mix
from modelgate.llm.dartminhash import dart_signatures, near_duplicate_free, near_duplicates, shingle_sets


def shingles(text):
    w = (text or "").lower().split()
    n = min(5, max(1, len(w)))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    """Smallest id of each id's class, by all pairs."""
    texts = [(i, shingles(t)) for i, t in rows if i is not None and shingles(t)]
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(texts):
        for j, b in texts[:x]:
            if len(a & b) >= 0.8 * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in texts}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(500)]
    rows, k = [], 0
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((k, " ".join(own)))
            k += 1
    return rows


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = mix(np.arange(1, 401, dtype=U64))
    wx, wy = rng.uniform(0, 3, 400), rng.uniform(0, 3, 400)
    keep = [wx > 0.4, wy > 0.4]
    flat = np.concatenate([elements[keep[0]], elements[keep[1]]])
    owner = np.concatenate([np.zeros(keep[0].sum(), dtype=np.int64), np.ones(keep[1].sum(), dtype=np.int64)])
    wx, wy = np.where(keep[0], wx, 0), np.where(keep[1], wy, 0)
    weights = np.concatenate([wx[keep[0]], wy[keep[1]]])
    sign = dart_signatures(flat, owner, 3, k=2048, weights=weights)
    want = np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()
    assert abs((sign[0] == sign[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 2048)
    assert not sign[2].any()  # an empty set


def test_shingle_sets():
    value, owner = shingle_sets(pa.array(["A b c d e f", None, "a B C d e f", "x", "", "x  y"]))
    sets = [set(value[owner == i].tolist()) for i in range(6)]
    assert sets[0] == sets[2] and len(sets[0]) == 2
    assert [len(s) for s in sets] == [2, 0, 2, 1, 0, 1]


def test_classes_equal_brute_force(spark):
    rows = corpus(3, 150) + [(1000, None), (1001, ""), (1002, " \n"), (None, "a b c"), (1003, "Hot " * 400), (1004, "hot " * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus(4, 60)
    rows = [(i, t, "a", 7) for i, t in rows] + [(0, rows[0][1], "a", 7), (None, "x y z", None, 1), (None, "x y z", None, 1), (900, None, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class__ string, rank__ int")
    out = near_duplicate_free(df)
    assert out.columns == df.columns
    got = [r["doc_id"] for r in out.collect()]
    want = set(brute([r[:2] for r in rows]).values()) | {900}
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 2
    assert near_duplicate_free(df.limit(0)).count() == 0


def test_id_with_two_texts_is_one_document(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "m n o")], "doc_id long, text string")
    assert {r["id"]: r["class_id"] for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
