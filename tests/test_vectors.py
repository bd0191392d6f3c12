"""Joins on vectors against all pairs, with copies, ties and unusable rows."""

import numpy as np
import pandas as pd
import pytest

from tripleweave.operators import blocking as bl
from tripleweave.operators import vectors as vc
from tripleweave.operators.blocking import embedding_blocking

SCHEMA = "id long, vec array<double>"


def clustered(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    v = centres[rng.integers(0, 4, n)] + rng.normal(scale=0.3, size=(n, dim))
    v[::7] = v[0]
    return v


def table(spark, v, odd=False):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    if odd:
        rows += [(1000, None), (1001, [0.0] * v.shape[1]), (1002, [None] + [1.0] * (v.shape[1] - 1))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("threshold", [0.99, 0.9, 0.5, -0.2, 1.0])
def test_threshold_join_equals_all_pairs(spark, threshold, monkeypatch):
    monkeypatch.setattr(vc, "CHUNK", 16)
    b = clustered(1, 120)
    a = b[:90]
    out = vc.cosine_links(table(spark, a, True), table(spark, b, True), threshold).collect()
    got = {(r["id_1"], r["id_2"]): round(r["score"], 9) for r in out}
    cosine = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    want = {(int(i), int(j)): round(float(cosine[i, j]), 9) for i, j in zip(*np.nonzero(cosine >= threshold - 1e-12))}
    assert got == want and len(out) == len(got) > 0


def test_tight_threshold_asks_few_places(spark):
    rng = np.random.default_rng(3)
    angle = rng.uniform(0, 2 * np.pi, 400)
    df = table(spark, np.stack([np.cos(angle), np.sin(angle)], 1))
    queries, members = vc.route_vectors(df, df, 0.9999, "id", "id", "vec", "vec")
    sizes = {(r["cell"], r["ring"]): r["count"] for r in members.groupBy("cell", "ring").count().collect()}
    met = sum(r["count"] * sizes.get((r["cell"], r["ring"]), 0) for r in queries.groupBy("cell", "ring").count().collect())
    assert met < 0.1 * 400 * 400


def test_threshold_join_of_nothing(spark):
    df = table(spark, clustered(2, 5))
    assert vc.cosine_links(df.limit(0), df, 0.9).count() == 0
    assert vc.cosine_links(df, df.limit(0), 0.9).columns == ["id_1", "id_2", "score"]
    with pytest.raises(ValueError):
        vc.cosine_links(df, df, 1.5)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_keep_the_smaller_ids_of_wide_ties(spark, metric):
    v = clustered(4, 60)
    v[10:40] = v[10]
    got = {(r["id_1"], r["rank"]): r["id_2"] for r in embedding_blocking(table(spark, v), table(spark, v), 4, metric).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = u @ u.T if metric == "cosine" else -np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for i in range(len(v)):
        order = sorted(range(len(v)), key=lambda j: (-round(float(score[i, j]), 9), j))[:4]
        assert [got[i, k] for k in (1, 2, 3, 4)] == order


def test_copies_of_a_vector_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(vc, "CHUNK", 16)
    v = clustered(5, 6)[[0] * 200 + [1, 2, 3] * 30]
    df = table(spark, v)
    asked = []
    route = vc.route_vectors
    monkeypatch.setattr(vc, "route_vectors", lambda a, b, *rest: asked.append((a.count(), b.count())) or route(a, b, *rest))
    out = vc.cosine_links(df, df, 0.9).collect()
    assert asked == [(4, 4)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.9 - 1e-12))}
    assert {(r["id_1"], r["id_2"]) for r in out} == want and len(out) == len(want)


def test_routed_rows_leave_a_task_in_pieces(monkeypatch):
    monkeypatch.setattr(bl, "COMPONENTS", 64 * 100)
    pieces = [range(1000)[s] for s in bl.in_pieces(1000, 64)]
    assert [x for p in pieces for x in p] == list(range(1000)) and max(map(len, pieces)) == 100
    assert len(list(bl.in_pieces(3, 10**9))) == 3


def test_every_vector_of_the_table_is_searched(spark, tmp_path):
    from queries.blocking import knn_embeddings

    v = clustered(6, 12)
    pd.DataFrame({"vec_id": range(1, 13), "embedding": [list(x) for x in v]}).to_parquet(tmp_path / "embeddings.parquet")
    got = {(r["id_1"], r["rank"]): r["id_2"] for r in knn_embeddings(spark, str(tmp_path)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i + 1, k + 1): j + 1 for i in range(12) for k, j in enumerate(sorted(range(12), key=lambda j: (-round(float((u @ u.T)[i, j]), 12), j))[:5])}
    assert got == want


def test_vectors_go_to_bins_in_chunks_and_strips(spark, monkeypatch):
    v = np.random.default_rng(7).normal(size=(300, 6))
    v[100:140] = v[0]
    monkeypatch.setattr(bl, "CHUNK", 8)
    monkeypatch.setattr(bl, "COMPONENTS", 6 * 20)
    got = {(r["id_1"], r["rank"]): r["id_2"] for r in embedding_blocking(table(spark, v), table(spark, v), 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(u @ u.T, 10)
    assert got == {(i, k + 1): int(j) for i in range(300) for k, j in enumerate(np.lexsort((np.arange(300), -score[i]))[:3])}


def test_bins_hold_near_cells():
    centres = np.array([[0.0], [10.0], [1.0], [11.0], [2.0]])
    bins = bl._in_bins(centres, np.array([3, 3, 3, 30, 3]), 10)
    assert bins[0] == bins[2] == bins[4] and bins[1] != bins[0] and bins[3] != bins[1]
