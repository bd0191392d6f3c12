"""Linking of mentions to entities with many words, against a plain computation."""

import math
from collections import Counter

from tripleweave.operators import linking as lk


def test_pairs_take_the_words_of_the_text(spark):
    texts = [(i, f"de w{i} w{i + 1} x") for i in range(20)]
    wide = " ".join(f"w{i}" for i in range(0, 4000, 2))
    own = [("/wide", wide), ("/thin", "w3 x"), ("/thin", "w4")]
    mentions = [(i, 0, 2, "de") for i in range(20)]
    priors = [("de", "/wide", 0.5), ("de", "/thin", 0.3), ("de", "/unknown", 0.2)]
    frames = [
        spark.createDataFrame(mentions, "doc_id long, start int, length int, surface string"),
        spark.createDataFrame(priors, "surface string, entity string, prior double"),
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(own, "entity string, text string"),
    ]
    context = {"/wide": Counter(wide.split()), "/thin": Counter("w3 x w4".split())}
    df = Counter(w for c in context.values() for w in c)
    vector = lambda c: {w: n * (math.log(3 / (1 + df[w])) + 1) for w, n in c.items() if w in df}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, text in texts:
        d = vector(Counter(text.split()))
        scores = []
        for _, entity, prior in priors:
            e = vector(context.get(entity, {}))
            dot = sum(x * e.get(w, 0.0) for w, x in d.items())
            scores.append((-round(0.5 * prior + 0.5 * (dot / norm(d) / norm(e) if dot else 0.0), 9), entity))
        want[i] = min(scores)
    out = lk.disambiguate(*frames)
    assert {r["doc_id"]: (-round(r["score"], 9), r["entity"]) for r in out.collect()} == want
    # Text and entity words meet on both at once: no row for every word of an entity in every text.
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Join Inner, ((entity" in plan and "(w" in plan
