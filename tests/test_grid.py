"""Shared blocks and common tokens counted in cells, against plain loops."""

import random
from collections import Counter
from itertools import product

from conftest import rows
from pyspark.sql import functions as F

from tripleweave.operators import matching as mt
from tripleweave.operators import meta

rng = random.Random(3)


def some_blocks(spark, clean):
    made = [(f"k{k}", side, f"e{e:03d}") for side in ((1, 2) if clean else (1,)) for e in range(40) for k in rng.sample(range(25), 4)]
    made += [("k1", 1, "e000"), ("k2", 1, None)]  # a repeated row and an entity without an id
    made += [("k3", 2, None)] if clean else []
    return made, spark.createDataFrame(made, "block_key string, side int, id string")


def shared(made, clean):
    sizes, out = Counter(k for k, _, _ in made), {}
    n1 = Counter(k for k, s, _ in made if s == 1)
    comparisons = {k: n1[k] * (n - n1[k]) if clean else n * (n - 1) // 2 for k, n in sizes.items()}
    for (k, s, a), (l, t, b) in product(made, made):
        if k == l and ((clean and s == 1 and t == 2) or (not clean and None not in (a, b) and a < b)):
            c = out.setdefault((a, b), [0, 0.0, 0.0])
            c[0], c[1], c[2] = c[0] + 1, c[1] + 1 / comparisons[k], c[2] + 1 / sizes[k]
    return out


def test_cells_count_shared_blocks(spark):
    for clean in (True, False):
        made, blocks = some_blocks(spark, clean)
        wanted = shared(made, clean)
        for span in (7, 1000):
            got = {(a, b): (c, x, y) for a, b, c, x, y in meta.comparison_propagation(blocks, clean, span=span).collect()}
            assert got.keys() == wanted.keys()
            assert all(abs(g - w) < 1e-9 for k in wanted for g, w in zip(got[k], wanted[k]))


def test_weights_do_not_depend_on_cells_and_no_pair_is_shuffled(spark):
    for clean in (True, False):
        _, blocks = some_blocks(spark, clean)
        for scheme in meta.SCHEMES:
            one, many = [
                rows(meta.edge_weights(blocks, scheme, clean, span=s).select("id_1", "id_2", F.round("weight", 9)).na.fill("-"))
                for s in (1000, 7)
            ]
            assert one == many and one
        plan = meta.edge_weights(blocks, "JS", clean)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(id_1" not in plan and "Exchange hashpartitioning(id_2" not in plan


def test_scores_of_pairs_in_cells(spark):
    vectors = spark.createDataFrame(
        [(s, e, f"t{t}", rng.random()) for s in (1, 2) for e in range(30) for t in rng.sample(range(40), 6 if s == 1 else 12)],
        "side int, id long, token string, weight double",
    )
    listed = [(a, b) for a in range(30) for b in range(32)] + [(1, 1)] * 2 + [(None, 3)]  # unknown, repeated, without id
    pairs = spark.createDataFrame(listed, "id_1 long, id_2 long")
    held = {1: {}, 2: {}}
    for s, e, t, w in vectors.collect():
        held[s].setdefault(e, {})[t] = w
    wanted = {}
    for (a, b), times in Counter(listed).items():
        x, y = held[1].get(a, {}), held[2].get(b, {})
        if x.keys() & y.keys():
            norm = lambda v: sum(w * w for w in v.values()) ** 0.5
            wanted[a, b] = times * sum(x[t] * y[t] for t in x.keys() & y.keys()) / norm(x) / norm(y)
    for span in (8, 1000):
        first, second = [vectors.where(f"side = {s}").select(F.col("id").alias(f"id_{s}"), "token", F.col("weight").alias(f"w{s}")) for s in (1, 2)]
        k = -(-30 // span)
        cells = {(r["id_1"], r["id_2"]): r["dot"] / r["l1"] / r["l2"] for r in mt._common_in_cells(pairs, first, second, k, k).collect()}
        scored = {(a, b): s for a, b, s in mt.score_pairs(pairs, vectors, span=span).collect()}
        for got in (cells, scored):
            assert got.keys() == wanted.keys()
            assert all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)


def test_an_entity_is_one_thin_row(spark):
    for clean in (True, False):
        made, blocks = some_blocks(spark, clean)
        members = meta._members(blocks, clean, ["common", "n"])
        assert members.columns == ["side", "id", "block"] and dict(members.dtypes)["block"] == "array<bigint>"
        ids = {(s, e) for _, s, e in made if clean or e is not None}
        assert {(r["side"], r["id"]) for r in members.collect()} == ids and members.count() == len(ids)
        assert set(meta._members(blocks, clean, ["common_sn", "sn"]).columns) == {"side", "id", "block", "size"}


def test_node_pruning_writes_no_edges(spark, monkeypatch):
    written, cut = [], meta.cut
    monkeypatch.setattr(meta, "cut", lambda df, label="state": (written.append(label), cut(df, label))[1])
    for clean in (True, False):
        _, blocks = some_blocks(spark, clean)
        edges = meta.edge_weights(blocks, "JS", clean, span=7).where("id_1 IS NOT NULL AND id_2 IS NOT NULL")
        listed = [tuple(r) for r in edges.collect()]
        ends = {}
        for a, b, w in listed:
            ends.setdefault((1, a), []).append(w)
            ends.setdefault((2 if clean else 1, b), []).append(w)
        side = 2 if clean else 1
        mean = lambda s, x: sum(ends[s, x]) / len(ends[s, x])
        top = lambda s, x: max(ends[s, x])
        near = 1 - 1e-9
        wanted = {
            meta.weighted_node_pruning: lambda a, b, w: w >= mean(1, a) * near or w >= mean(side, b) * near,
            meta.reciprocal_weighted_node_pruning: lambda a, b, w: w >= mean(1, a) * near and w >= mean(side, b) * near,
            meta.blast: lambda a, b, w: w >= (top(1, a) + top(side, b)) / 4 * near,
        }
        for prune, keeps in wanted.items():
            assert {(a, b) for a, b, _ in prune(edges, clean).collect()} == {(a, b) for a, b, w in listed if keeps(a, b, w)}
    assert written and "edges" not in written


def test_edges_chosen_in_the_cells_leave_results_as_they_are(spark):
    from tripleweave.operators import cluster as cl

    for clean in (True, False):
        _, blocks = some_blocks(spark, clean)
        edges = meta.edge_weights(blocks, "JS", clean).withColumn("weight", F.round("weight", 3))
        prunings = {"best": meta.cardinality_edge_pruning, "best of ends": meta.cardinality_node_pruning}
        wanted = {only: rows(prune(edges, blocks, clean)) for only, prune in prunings.items()}
        for span in (7, 1000):
            for only, prune in prunings.items():
                chosen = meta.edge_weights(blocks, "JS", clean, span, only, decimals=3)
                assert rows(prune(chosen, blocks, clean)) == wanted[only] and wanted[only]
        if not clean:
            few = meta.edge_weights(blocks, "JS", clean, 7, "connecting", 0.3, 3)
            assert few.count() < edges.where("weight > 0.3").count()
            assert rows(cl.connected_components(few, 0.3)) == rows(cl.connected_components(edges, 0.3))


def test_copies_of_an_entity_are_bounded(spark):
    for n, clean in ((400_000, False), (200_000, True)):
        members = spark.range(n).select(F.lit(1).alias("side"), "id")
        members = members.unionAll(spark.range(n).select(F.lit(2), "id")) if clean else members
        assert max(meta._parts(members, clean, meta.SPAN)) <= 64


def test_weights_in_cells_round_as_spark_does():
    import numpy as np

    assert meta._rounded(np.array([1 / 1024, 0.12345, 2 / 3, 0.5]), 9).tolist() == [0.000976563, 0.12345, 0.666666667, 0.5]
