"""Nearest examples over all terms, against cosines of every pair."""

import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from tripleweave.llm import toxicity

WORDS = [f"w{i}" for i in range(400)]
BAD = ["vile", "hateful", "slur"]


def text(rng, bad=0.0):
    words = [WORDS[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randint(5, 60))]
    return " ".join(words + ([rng.choice(BAD)] * rng.randint(1, 3) if rng.random() < bad else []))


@pytest.fixture
def rows():
    rng = random.Random(5)
    out = [(i, text(rng, 0.95 if i % 5 == 0 else 0.02), int(i % 5 == 0)) for i in range(300)]
    return out + [(300, out[0][1], 1), (301, out[1][1], 0), (302, "", 0), (303, "w399 " * 20_000 + "vile", 1)]


def make(rows):
    counts = [(i, label, Counter(toxicity.words_of(t))) for i, t, label in rows]
    terms = sorted({w for _, _, c in counts for w in c})
    number = {w: i for i, w in enumerate(terms)}
    df = np.array([sum(w in c for _, _, c in counts) for w in terms])
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    return toxicity.Model(terms, idf, [(i, label, {number[w]: n for w, n in c.items()}) for i, label, c in counts], 7, 0.2)


def plain_weights(model, rows, words, own=None):
    """Unit weights by word, from counts over all examples."""
    examples = [(label, set(toxicity.words_of(t))) for i, t, label in rows if i != own]
    n, n_toxic = len(examples), sum(label for label, _ in examples)
    out = {}
    for w, tf in Counter(words).items():
        held = sum(w in x for _, x in examples)
        expected = held * n_toxic / n
        spread = math.sqrt(max(expected * (1 - held / n) * (1 - n_toxic / n), 1e-9))
        z = max(0.0, sum(label for label, x in examples if w in x) - expected) / spread if held else 0.0
        out[w] = (1 + math.log(tf)) * model.idf[model.words.index(w)] * (1 + z * z)
    norm = math.sqrt(sum(x * x for x in out.values()))
    return {w: x / norm for w, x in out.items()}


@pytest.mark.parametrize(("block", "full", "first"), [(128, 1024, 4), (4, 0, 1), (3, 20, 2), (1, 5, 400)])
def test_nearest_equal_all_cosines(rows, monkeypatch, block, full, first):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "FULL_TERMS", full)
    monkeypatch.setattr(toxicity, "FIRST", first)
    model = pickle.loads(pickle.dumps(make(rows)))
    by_id = {i: t for i, t, _ in rows}
    vectors = [plain_weights(model, rows, toxicity.words_of(by_id[i])) for i in model.ids]
    rng = random.Random(9)
    for t in [text(rng, 0.3) for _ in range(40)] + ["vile", "w1 unheard", rows[0][1]]:
        query = plain_weights(model, rows, [w for w in toxicity.words_of(t) if w in model.words])
        cosines = [sum(x * v.get(w, 0.0) for w, x in query.items()) for v in vectors]
        ranked = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)
        least = -ranked[min(len(ranked), model.k) - 1][0]
        (_, found), = model.scores([model.count(t)])
        assert len(found) >= min(len(ranked), model.k)
        assert all(abs(cosines[i] - c) < 1e-6 for c, i in found) and all(-c < least + 1e-6 for c, i in ranked if i not in {j for _, j in found})


def test_an_example_is_weighed_without_its_own_label(rows):
    model = make(rows)
    for i, t, label in rows[:20]:
        at, weights = model.weigh(model.count(t), label)
        plain = plain_weights(model, rows, toxicity.words_of(t), own=i)
        held_by_others = {w for j, u, _ in rows if j != i for w in toxicity.words_of(u)}
        assert all(abs(plain[model.words[a]] - w) < 1e-9 for a, w in zip(at.tolist(), weights.tolist(), strict=True) if model.words[a] in held_by_others)


def test_scores_find_toxic_texts_and_do_not_depend_on_the_group(rows):
    model = make(rows)
    rng = random.Random(3)
    texts = [text(rng, float(i % 2)) for i in range(200)] + ["", "unheard"]
    counts = [model.count(t) for t in texts]
    together = [s for s, _ in model.scores(counts)]
    assert together == [s for c in counts for s, _ in model.scores([c])] and together[-2:] == [model.no_vote] * 2
    hits = [s >= toxicity.CUT for s in together[:200]]
    assert sum(hits[1::2]) >= 95 and sum(hits[0::2]) <= 5


def test_sample_ends_before_the_bound_of_characters(spark):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * 20) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, max_chars=1050).ids) == 10
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert min(scores[i] for i in range(1, 40, 2)) > 0.9 and max(scores[i] for i in range(0, 40, 2)) < 0.1
    kept = toxicity.reject(docs, toxicity.fit(docs, labels)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 40, 2))
