"""Spotted mentions against a plain longest-first scan."""

import random

import pytest
from conftest import rows
from tripleweave.operators import linking


def plain(text, surfaces, longest):
    words, at, out = text.split(" "), [], []
    for w in words:
        at.append(at[-1] + len(words[len(at) - 1]) + 1 if at else 0)
    taken = set()
    for n in range(longest, 0, -1):
        for i in range(len(words) - n + 1):
            surface = " ".join(words[i : i + n])
            if surface and surface in surfaces and not taken & set(range(i, i + n)):
                taken |= set(range(i, i + n))
                out.append((at[i], len(surface), surface))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spots_equal_a_plain_scan(spark, seed):
    rng = random.Random(seed)
    surfaces = {" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(25)}
    texts = [(i, " ".join(rng.choice(["a", "b", "c", "d", "ee", ""]) for _ in range(rng.randint(0, 60)))) for i in range(30)] + [(30, ""), (31, None)]
    longest = max(len(s.split(" ")) for s in surfaces)
    want = sorted((i, *x) for i, t in texts if t is not None for x in plain(t, surfaces, longest))
    found = linking.spot_mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(s,) for s in surfaces], "surface string"))
    assert want and rows(found) == want


def test_a_long_text_is_spotted_in_one_pass(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(40)}" for _ in range(20_000))
    surfaces = {f"w{i} w{j}" for i in range(40) for j in range(0, 40, 3)} | {f"w{i}" for i in range(0, 40, 2)}
    found = linking.spot_mentions(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(s,) for s in surfaces], "surface string"))
    assert rows(found) == sorted((1, *x) for x in plain(text, surfaces, 2))
