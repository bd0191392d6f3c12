"""Candidates that occur together in a fact, against plain loops over the pairs of a text."""

import random

from conftest import rows

from tripleweave.operators import linking as lk


def plain(ents, rels, facts, heads):
    fwd, bwd = [{pair for pair in pairs if None not in pair} for pairs in ({(s, p) for s, p, _ in facts}, {(o, p) for _, p, o in facts})]
    keyed = [(e[0], e[1], e[2], e[3], r[1], r[2], r[3]) for e in ents for r in rels if e[0] == r[0] is not None]
    place = lambda x: tuple((v is not None, v or 0) for v in x)
    first = {}
    for d, em, eu, er, rm, ru, rr in keyed:
        if (eu, ru) in fwd and em is not None and rm is not None:
            first[d, em, rm] = min(first.get((d, em, rm), place((er, rr))), place((er, rr)))
    gains = {}
    for d, em, eu, er, rm, ru, rr in keyed:
        at = first.get((d, em, rm))
        ahead = (eu, ru) in fwd and at == place((er, rr))
        behind = (eu, ru) in bwd and (at is None or place((er, rr)) < at)
        for head in [h for i, h in heads if i == d] or [None]:
            gain = (45 if head == "who" else 40) if ahead else (15 if head == "who" else 12) if behind else 0
            for key in (("e", d, em, eu), ("r", d, rm, ru)):
                gains[key] = gains.get(key, 0) + gain
    boosted = lambda kind, listed: sorted(((*c[:4], c[4] + (gains.get((kind, *c[:3]), 0) if c[1] is not None else 0)) for c in listed), key=repr)
    return boosted("e", ents), boosted("r", rels)


def some(rng, n, prefix):
    uris = [f"{prefix}{i}" for i in range(6)] + [None]
    return [(rng.choice([1, 2, 3, 4, None]), rng.choice(["a", "b", None]), rng.choice(uris), rng.choice([1, 2, 3, None]), 0) for _ in range(n)]


def test_pairs_of_a_text_meet_their_facts(spark):
    kind = "doc_id long, mention string, uri string, rank int, boost int"
    for seed in range(3):
        rng = random.Random(seed)
        ents, rels = some(rng, 30, "n"), some(rng, 30, "p")
        facts = [(f"n{rng.randrange(6)}", f"p{rng.randrange(8)}", f"n{rng.randrange(6)}") for _ in range(12)] + [(None, "p1", "n1"), ("n2", None, "n1")]
        heads = [(1, "who"), (2, "what"), (3, None), (1, "who")]
        made = [spark.createDataFrame(x, k) for x, k in ((ents, kind), (rels, kind), (facts, "s string, p string, o string"), (heads, "doc_id long, head string"))]
        got = [sorted((tuple(r) for r in d.select("doc_id", "mention", "uri", "rank", "boost").collect()), key=repr) for d in lk.rerank_by_triples(*made)]
        assert got == list(plain(ents, rels, facts, heads))


def test_an_entity_is_not_spread_over_its_predicates(spark, monkeypatch):
    written, cut = {}, lk.cut

    def counting(df, label="state"):
        out = cut(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(lk, "cut", counting)
    ents = spark.createDataFrame([(d, "m", "n", 1, 0) for d in range(20)], "doc_id long, mention string, uri string, rank int, boost int")
    rels = spark.createDataFrame([(d, "r", f"p{d}", 1, 0) for d in range(20)], ents.schema)
    facts = spark.createDataFrame([("n", f"p{i}", "o") for i in range(10, 300)], "s string, p string, o string")
    heads = spark.createDataFrame([(d, "what") for d in range(20)], "doc_id long, head string")
    found, _ = lk.rerank_by_triples(ents, rels, facts, heads)
    assert rows(found.select("doc_id", "boost")) == [(d, 40 if d >= 10 else 0) for d in range(20)]
    assert written["hits"] == 10
