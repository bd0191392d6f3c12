import itertools
import random

import numpy as np

from conftest import rows
from pyspark.sql import functions as F
from tripleweave.functions import text as tx
from tripleweave.operators import blocking as bl
from tripleweave.operators import meta
from tripleweave.operators.schema import near_values


def texts(spark, data, side=1):
    return spark.createDataFrame([(side, i, t) for i, t in enumerate(data)], "side int, id int, text string")


def test_standard_blocks_drop_single_entities(spark):
    blocks = bl.standard_blocking(texts(spark, ["Big red-bike", "red car", "blue sky, red"]))
    assert rows(blocks) == [("red", 1, 0), ("red", 1, 1), ("red", 1, 2)]


def test_qgrams_of_short_and_long_values(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",), ("éàüö",)], "t string")
    got = [r[0] for r in df.select(tx.qgrams(F.col("t"), 3)).collect()]
    assert got == [["abc", "bcd"], ["ab"], [], ["éàü", "àüö"]]


def test_gram_combinations_against_subsets(spark):
    df = spark.createDataFrame([("abcdef",)], "t string")
    grams = ["abc", "bcd", "cde", "def"]
    for threshold in (0.95, 0.6, 0.3):
        least = max(1, int(len(grams) * threshold))
        want = {"".join(c) for n in range(least, 5) for c in itertools.combinations(grams, n)}
        got = df.select(F.explode(bl.gram_combinations(tx.qgrams(F.col("t"), 3), threshold))).collect()
        assert {r[0] for r in got} == want


def test_chunked_pairs_are_complete(spark):
    data = [("hot", 1 + i % 2, i) for i in range(23)] + [("cold", 1, 1), ("cold", 2, 2)]
    blocks = spark.createDataFrame(data, "block_key string, side int, id int")
    for clean in (False, True):
        whole = rows(bl.block_pairs(blocks, clean).select("id_1", "id_2"))
        cut = rows(bl.block_pairs(blocks, clean, chunk=4).select("id_1", "id_2"))
        assert whole == cut
    assert len(whole) == 12 * 11 + 1


def test_purging_drops_the_large_block(spark):
    sizes = {"a": 2, "b": 2, "c": 3, "d": 9}
    data = [(k, 1, i) for k, n in sizes.items() for i in range(n)]
    blocks = spark.createDataFrame(data, "block_key string, side int, id int")
    kept = {r[0] for r in bl.block_purging(blocks).select("block_key").distinct().collect()}
    assert "d" not in kept or kept == set(sizes)


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["the"] * 6 + [f"w{i}" for i in range(12)]
    a = [(i, " ".join(rng.choices(words, k=6))) for i in range(15)]
    b = [(i, " ".join(rng.choices(words, k=6))) for i in range(15)]
    da, db = (spark.createDataFrame(x, "id int, t string") for x in (a, b))
    for need in (1, 2, 3):
        got = rows(bl.overlap_blocking(da, db, "id", "id", "t", "t", overlap_size=need))
        want = sorted(
            (i, j, len(set(x.split()) & set(y.split()))) for i, x in a for j, y in b if len(set(x.split()) & set(y.split())) >= need
        )
        assert got == want


def test_overlap_join_with_missing_values(spark):
    a = spark.createDataFrame([(1, "x y"), (2, "")], "id int, t string")
    b = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    got = rows(bl.overlap_blocking(a, b, "id", "id", "t", "t", allow_missing=True).select("id_1", "id_2"))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 6)), rng.normal(size=(60, 6))
    b[10:20] = b[0]  # a group of copies
    da, db = (spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, vec array<double>") for m in (a, b))
    for metric in ("cosine", "euclidean"):
        if metric == "cosine":
            score = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        else:
            score = -np.linalg.norm(a[:, None] - b[None], axis=2)
        want = sorted((i, int(j)) for i in range(20) for j in np.lexsort((np.arange(60), -np.round(score[i], 10)))[:3])
        assert rows(bl.embedding_blocking(da, db, 3, metric, pivots=4).select("id_1", "id_2")) == want


def test_near_values_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 16))) for _ in range(60)}
    words |= {"customer street", "custmer street", "customer  streat", "a customer street"}
    x, y = sorted(words)[::2], sorted(words)[1::2]

    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        return row[-1]

    want = sorted((s, t) for s in x for t in y if lev(s, t) * 5 <= max(len(s), len(t)))
    got = rows(near_values(*(spark.createDataFrame([(w,) for w in ws], "v string") for ws in (x, y))))
    assert got == want


def test_edge_pruning_keeps_equal_weights(spark):
    edges = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.1), (1, 2, 0.1)], "id_1 int, id_2 int, weight double")
    assert meta.weighted_edge_pruning(edges).count() == 3
    assert meta.reciprocal_weighted_node_pruning(edges).count() == 3
