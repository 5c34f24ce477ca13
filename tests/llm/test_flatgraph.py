import numpy as np
import pytest

from tidewell.llm import flatgraph
from tidewell.llm.flatgraph import APART, apart, fit_centers, link_vectors, unit

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def brute(rows, least=0.95):
    ids = [r[0] for r in rows]
    sound = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    x = [np.asarray(v, np.float32).astype(float) if s else None for (_, v), s in zip(rows, sound)]
    link = [[False] * len(rows) for _ in rows]
    for i, a in enumerate(x):
        for j, b in enumerate(x):
            if i != j and a is not None and b is not None and len(a) == len(b):
                link[i][j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least
    low = list(ids)
    while True:
        new = [min([low[i]] + [low[j] for j in range(len(rows)) if link[i][j]]) for i in range(len(rows))]
        if new == low:
            return sorted((ids[i], sum(link[i]), low[i], low[i] == ids[i]) for i in range(len(rows)))
        low = new


def test_matches_brute_force_and_edges(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(260, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(40):
        rows.append((1000 + i, (base[i % 7] + r.normal(size=16) * 0.08).tolist()))
    rows += [(2000 + i, rows[5][1]) for i in range(4)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [3e38] * 16), (3008, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 5) for i, v in rows], SCHEMA)
    want = brute([(i, [float(np.float32(c)) if c is not None else None for c in v] if v is not None else None) for i, v in rows])
    assert sorted(map(tuple, link_vectors(df, block=64).collect())) == want
    assert sum(w[1] for w in want) > 100
    # every cluster gets centers of its own
    assert sorted(map(tuple, link_vectors(df, block=64, split=40).collect())) == want


def test_centers_keep_a_dense_group_together():
    r = np.random.default_rng(5)
    group = unit((r.normal(size=8) + r.normal(size=(300, 8)) * 0.02).tolist())
    far = unit(r.normal(size=(40, 8)).tolist())
    centers = apart(fit_centers(np.concatenate([group, far]), 32))
    assert (centers @ centers.T - np.eye(len(centers))).max() < APART
    assert len(set((group @ centers.T).argmax(axis=1).tolist())) == 1


def test_missed_links_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "_audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError):
        link_vectors(spark.createDataFrame([(i, [1.0, float(i)], 1, 5) for i in range(4)], SCHEMA), probes=64)


def test_empty(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
