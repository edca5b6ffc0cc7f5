import numpy as np
import pytest

from modelgate.llm import cosine


def brute(rows, threshold=0.98):
    good = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        good.append((i, label, x / np.sqrt((x * x).sum())))
    links = {}
    parent = {i: i for i, _, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, la, x) in enumerate(good):
        for j, lb, y in good[:a]:
            if la == lb and len(x) == len(y) and i != j and x @ y >= threshold:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (links.get(i, 0), root(i)) for i in parent}


@pytest.mark.parametrize("block", [4, 1024])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cosine, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(40):
        centre = rng.normal(size=12)
        for _ in range(rng.choice([1, 2, 5, 30]) if g else 60):
            rows.append((len(rows), (centre + rng.normal(size=12) * 0.05).astype(np.float32).tolist(), int(g % 3)))
    bad = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, None] + [0.5] * 10]
    rows += [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(2000, rows[0][1], None), (2001, [1.0, 2.0], 0), (2002, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + [(None, rows[0][1], 0)], "vec_id long, embedding array<float>, label int")
    got = cosine.near_duplicate_vectors(df).collect()
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert len(got) == len(rows) + 1
    for r in got:
        if r["id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == want[r["id"]], r
            assert r["kept"] == (r["component_id"] == r["id"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cosine.near_duplicate_vectors(df).count() == 0


def test_visits_hold_every_neighbours_home():
    rng = np.random.default_rng(3)
    x = cosine.unit(rng.normal(size=(300, 6)))
    y = cosine.unit(x + rng.normal(size=x.shape) * 0.06)
    centres = cosine.spherical_kmeans(x, 12)
    hx, hy = (x @ centres.T).argmax(axis=1), (y @ centres.T).argmax(axis=1)
    row, cell, _ = cosine.visits(x, centres, 0.98)
    seen = set(zip(row.tolist(), cell.tolist(), strict=True))
    for i in np.flatnonzero((x * y).sum(axis=1) >= 0.98):
        if hy[i] <= hx[i]:
            assert (i, hy[i]) in seen
