"""Mutual best matches by shared objects, against all pairs."""

import random

import pytest
from conftest import rows

from tripleweave.operators import kb_align as kb


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_best_matches_equal_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    objects = ["x", "y", "z"] * 6 + [f"o{i}" for i in range(25)]
    side = lambda n: [(f"e{rng.randrange(n)}", rng.choice(objects)) for _ in range(90)]
    a = spark.createDataFrame(side(30), "e1 string, o string")
    b = spark.createDataFrame([*side(35), ("e1", None)], "e2 string, o string")
    score = lambda d: d.selectExpr("e1", "e2", "n / 4.0D score")
    every = kb.shared_objects(a, b)
    best = kb.shared_objects(a, b, dominated=False, heavy_degree=3)
    assert rows(kb.bilateral_max(score(best))) == rows(kb.bilateral_max(score(every)))
    assert best.count() < every.count() and set(rows(best)) <= set(rows(every))


def test_entities_better_matched_elsewhere_are_not_listed(spark):
    a = spark.createDataFrame([x for i in range(300) for x in ((i, "segment"), (i, f"name {i}"))], "e1 int, o string")
    best = kb.shared_objects(a, a.withColumnRenamed("e1", "e2"), dominated=False)
    assert rows(best) == [(i, i, 2) for i in range(300)]
    none = kb.shared_objects(a, a.limit(0).withColumnRenamed("e1", "e2"), dominated=False)
    assert none.count() == 0


def test_equal_sets_are_looked_up_once(spark, monkeypatch):
    facts = [("n1", "in", f"c{i}") for i in range(40)] + [("n2", "in", f"c{i}") for i in range(30, 60)] + [("g1", "seg", f"c{i}") for i in range(0, 60, 2)]
    f = spark.createDataFrame(facts, "s string, p string, o string")
    holds = {}
    for s, p, o in facts:
        holds.setdefault((s, p), set()).add(o)
    kinds = [[("n1", "in"), ("g1", "seg")], [("n2", "in"), ("g1", "seg")], [("n1", "in"), ("n2", "in")], [("n1", "in")], [("n1", "in"), ("g1", "none")]]
    sets = [(i, s, p) for i in range(50) for s, p in kinds[i % 5]] + [(None, "n1", "in"), (99, "none", "in")]
    given = spark.createDataFrame(sets, "set_id int, s string, p string")
    looked = []
    cut = kb.cut
    monkeypatch.setattr(kb, "cut", lambda df, label: looked.append(cut(df, label)) or looked[-1])
    got = {r["set_id"]: r["score"] for r in kb.joint_local_functionality(f, given).collect()}
    want = {i: 1.0 / len(set.intersection(*[holds[x] for x in kinds[i % 5] if x in holds])) for i in range(50)}  # an unknown fact says nothing
    assert got == pytest.approx(want)
    assert set(got) == set(want) and looked[0].select("_class").distinct().count() == 6
