import random
from collections import defaultdict
from itertools import combinations, product

import pytest
from conftest import rows
from pyspark.sql import functions as F
from tripleweave.operators import kb_align as kb
from tripleweave.operators import prob_align as pa
from tripleweave.plans.rounds import cut

FACT = "s string, p string, o string, o_is_literal boolean"


def random_kb(spark, seed, side, n=14):
    rng = random.Random(seed)
    out = set()
    for i in range(n):
        out.add((f"{side}:e{i}", f"{side}:name", f"n{i % 11}", True))
        out.add((f"{side}:e{i}", f"{side}:type", f"{side}:t{i % 2}", False))
        if rng.random() < 0.8:
            out.add((f"{side}:e{i}", f"{side}:in", f"{side}:c{rng.randrange(3)}", False))
        out.add((f"{side}:e{i}", f"{side}:knows", f"{side}:e{rng.randrange(n)}", False))
    return spark.createDataFrame(sorted(out), FACT)


def inverse(p):
    return p[:-3] if p.endswith("^-1") else p + "^-1"


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_functionality_equals_listing_all_pairs(spark, seed):
    facts = kb.load_facts(random_kb(spark, seed, "a"))
    by_subject = defaultdict(list)
    for s, p, o in rows(facts):
        by_subject[s].append((inverse(p), o))
    count, seen = defaultdict(int), defaultdict(set)
    for fs in by_subject.values():
        for x, y in combinations(fs, 2):
            key = tuple(sorted((x[0], y[0])))
            count[key] += 1
            seen[key].add(tuple(sorted((x[1], y[1]))))
    want = {k: len(seen[k]) / count[k] for k in count}
    got = {(a, b): v for a, b, v in rows(kb.functionality_pairs(facts))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("predicates", [["p"], ["p", "q"], ["p", "p"], ["p", "p", "q"], ["p", "q", "r"], ["q", "q", "q"], ["none"], ["p", "none"]])
def test_functionality_of_equals_listing_all_tuples(spark, predicates):
    rng = random.Random(7)
    made = {(f"s{s}", p, f"o{o}") for s in range(7) for p in "pqr" for o in range(9) if rng.random() < 0.3}
    made |= {(s, p, f"h{o}") for s in ("s0", "s1") for p in "pq" for o in range(12)}  # interchangeable objects
    facts = spark.createDataFrame([(s, inverse(p), o) for s, p, o in sorted(made)], "s string, p string, o string")
    listed = []
    for s in sorted({f[0] for f in made}):
        per = [combinations(sorted(o for x, q, o in made if (x, q) == (s, p)), predicates.count(p)) for p in sorted(set(predicates))]
        listed += [tuple(sorted(sum(parts, ()))) for parts in product(*per)]
    want = len(set(listed)) / len(listed) if listed else 0.0
    assert abs(kb.functionality_of(facts, predicates).first()["score"] - want) < 1e-12


def test_functionality_of_a_hub_lists_no_tuples(spark):
    facts = spark.range(3000).selectExpr("explode(array('a', 'b')) AS s", "id").selectExpr("s", "explode(array('p^-1', 'q^-1', 'r^-1')) AS p", "concat('o', id) AS o")
    n = 3000
    # Of the n^3 ordered choices of each subject the distinct multisets are those of size 3 out of n.
    assert abs(kb.functionality_of(facts, ["p", "q", "r"]).first()["score"] - (n * (n + 1) * (n + 2) / 6) / (2 * n**3)) < 1e-12


def setting(spark):
    f1, f2 = (cut(kb.load_facts(random_kb(spark, s, side))) for s, side in ((1, "a"), (2, "b")))
    seeds = spark.createDataFrame([(f'"n{i}"', f'"n{i}"', 1.0) for i in range(9)] + [("a:c0", "b:c0", 0.8), ("a:t0", "b:t0", 0.7)], "e1 string, e2 string, score double")
    fun = kb.merge_functionality(kb.functionality(f1), kb.functionality(f2), ["p"])
    given = spark.createDataFrame([(f"a:name{i}", f"b:name{i}", 0.9) for i in ("", "^-1")], "p1 string, p2 string, score double")
    return f1, f2, seeds, cut(fun), cut(kb.init_subsumption(f1, f2, given))


def test_pruned_bootstrap_gives_the_same_matches(spark):
    f1, f2, seeds, fun, sub = setting(spark)
    full = cut(kb.bootstrap(f1, f2, seeds, sub, fun))
    pruned = cut(kb.bootstrap(f1, f2, seeds, sub, fun, dominated=False))
    assert pruned.count() < full.count()
    assert rows(kb.bilateral_max(pruned)) == rows(kb.bilateral_max(full))


def test_pruned_evidence_selects_the_same_candidates(spark):
    f1, f2, seeds, fun, sub = setting(spark)
    matches = cut(kb.bilateral_max(cut(kb.bootstrap(f1, f2, seeds, sub, fun))))
    quasi = cut(kb.quasi_equivalence(cut(kb.map_subrelations(f1, f2, matches, sub)), f1, f2))

    def selected(degree):
        found = cut(kb.search_evidence(f1, f2, matches, quasi, heavy_degree=degree))
        return rows(kb.select_candidates(found, matches))

    full = selected(None)
    for degree in (1, 4):
        assert selected(degree) == full
    assert full


def test_bilateral_max_keeps_ties_and_prefers_itself(spark):
    scores = spark.createDataFrame(
        [("a", "x", 0.9), ("a", "y", 0.9), ("b", "x", 0.9), ("b", "z", 0.5), ("s", "s", 1.0), ("t", "s", 1.0), ("c", "z", 0.7)], "e1 string, e2 string, score double"
    )
    got = {(r[0], r[1]) for r in rows(kb.bilateral_max(scores))}
    pairs = {("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")}
    assert got == pairs | {(b, a) for a, b in pairs} | {("s", "s")}


def test_align_kbs_finds_renamed_entities(spark):
    def side(n, drop):
        out = []
        for i in range(8):
            out += [(f"{n}:e{i}", f"{n}:name", f"thing {i}", True), (f"{n}:e{i}", f"{n}:next", f"{n}:e{(i + 1) % 8}", False)]
        return spark.createDataFrame([t for t in out if t not in drop], FACT)

    f1 = kb.load_facts(side("a", []))
    f2 = kb.load_facts(side("b", [("b:e3", "b:name", "thing 3", True)]))
    seeds = spark.createDataFrame([], "e1 string, e2 string, score double")
    matches, sub = kb.align_kbs(f1, f2, seeds, init=0.99, max_iter=3)
    found = {(r["e1"], r["e2"]) for r in matches.where("e1 LIKE 'a:%'").collect()}
    assert {(f"a:e{i}", f"b:e{i}") for i in range(8)} <= found
    best = {(r["p1"], r["p2"]): r["score"] for r in sub.collect()}
    assert best[("a:next", "b:next")] > best[("a:next", "b:name")]
    assert all(0 <= v <= 1 for v in best.values())


def test_probabilistic_alignment(spark):
    rows_of = lambda n: [
        t for i in range(6) for t in ((f"{n}:p{i}", f"{n}:phone", f"555 {i}", True), (f"{n}:p{i}", f"{n}:city", "town", True))
    ]
    f1, f2 = (kb.load_facts(spark.createDataFrame(rows_of(n), FACT)) for n in "ab")
    instances, relations = pa.align_probabilistic(f1, f2, 4)
    got = {r["e1"]: (r["e2"], r["score"]) for r in instances.collect()}
    assert {k: v[0] for k, v in got.items()} == {f"a:p{i}": f"b:p{i}" for i in range(6)}
    assert all(0 <= v[1] <= 1 for v in got.values())
    best = {(r["p1"], r["p2"]): r["sub"] for r in relations.collect()}
    assert best[("a:phone", "b:phone")] > 0.9


def test_literal_matches(spark):
    lit = lambda vs, n: kb.load_facts(spark.createDataFrame([(f"{n}{i}", "p", v, True) for i, v in enumerate(vs)], FACT))
    a, b = lit(["New York", "Berlin Mitte", "Rome"], "a"), lit(["new york!", "Berlin Mitta", "Oslo"], "b")
    got = {(r["e1"], r["e2"]): r["score"] for r in kb.match_literals(a, b, 0.7).collect()}
    assert got[('"New York"', '"new york!"')] == 1.0
    assert 0.7 <= got[('"Berlin Mitte"', '"Berlin Mitta"')] < 1
    assert len(got) == 2
    assert a.where(F.col("p") == "p^-1").count() == 3


def plain_rules(selected, f1, f2, fun, pairs):
    """Every prefix of every list by itself."""
    objects = [defaultdict(set), defaultdict(set)]
    for found, facts in zip(objects, (f1, f2), strict=True):
        for s, p, o in facts:
            found[s, p].add(o)
    lists = defaultdict(list)
    for r in selected:
        lists[r["s1"], r["s2"]].append((-min(r["m"], r["q"]), r["rank"], r["o2"], r["q2"], r["o1"], r["q1"], r["m"], r["q"]))
    best = {}
    for key, ev in lists.items():
        ev.sort()
        for n in range(1, len(ev) + 1):
            head = ev[:n]
            o1, o2 = [e[4] for e in head], [e[2] for e in head]
            if [o1.index(x) for x in o1] != [o2.index(x) for x in o2]:
                break
            parts = [1.0, n / sum(1 / e[6] for e in head), n / sum(1 / e[7] for e in head)]
            for found, o, q in ((objects[0], 4, 5), (objects[1], 2, 3)):
                parts.append(1 / len(set.intersection(*(found[e[o], e[q]] for e in head))))
                names = sorted(e[q] for e in head)
                parts.append(fun.get(names[0], 1.0) if n == 1 else pairs.get(tuple(names), 1.0) if n == 2 else 1.0)
            best[key] = max(best.get(key, 0.0), min(parts))
    return {k: v for k, v in best.items() if v > 0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_equal_scoring_every_prefix(spark, seed):
    rng = random.Random(seed)
    sides, triples = [], []
    for side in "ab":
        facts = {(f"{side}:h{h}", f"{side}:p{p}", f"{side}:e{i}") for i in range(30) for h in range(9) for p in range(3) if rng.random() < (0.9 if h == 0 else 0.25)}
        sides.append(sorted(facts))
        triples.append(cut(spark.createDataFrame(sides[-1], "s string, p string, o string")))
    selected = []
    for i in range(30):
        for j in (i, (i + 7) % 30):
            mine, theirs = ([f for f in s if f[2] == f"{n}:e{k}"] for s, n, k in zip(sides, "ab", (i, j), strict=True))
            rng.shuffle(theirs)
            for rank, (x, y) in enumerate(zip(mine, theirs, strict=False), 1):
                aligned = [z for z in theirs if z[0][2:] == x[0][2:] and z not in {s[-1] for s in selected if s[0] == (i, j)}]
                selected.append(((i, j), x, rank, rng.choice([0.4, 0.8, 1.0]), rng.choice([0.5, 1.0]), aligned[0] if aligned and rng.random() < 0.9 else y))
    width = defaultdict(int)
    for s in selected:
        width[s[0]] += 1
    table = [(x[2], y[2], x[0], x[1], y[0], y[1], m, q, rank, width[key]) for key, x, rank, m, q, y in selected]
    df = spark.createDataFrame(table, "s1 string, s2 string, o1 string, q1 string, o2 string, q2 string, m double, q double, rank int, max_n long")
    fun = {f"{n}:p{k}": 0.3 + 0.2 * k for n in "ab" for k in range(3)}
    pairs = {(f"{n}:p{j}", f"{n}:p{k}"): 0.5 + 0.1 * j + 0.05 * k for n in "ab" for j in range(3) for k in range(j, 3)}
    want = plain_rules(df.collect(), *sides, fun, pairs)
    got = kb.apply_rules(
        df, *triples, spark.createDataFrame(list(fun.items()), "p string, score double"),
        spark.createDataFrame([(*k, v) for k, v in pairs.items()], "p1 string, p2 string, score double"),
    )
    got = {(r["e1"], r["e2"]): r["score"] for r in got.collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
