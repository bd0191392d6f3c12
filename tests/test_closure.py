"""Closures against a plain fixpoint over single triples, and large classes without their pairs."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from tripleweave.operators import reason as rs
from tripleweave.operators.schema import OWL, RDF_TYPE


def plain_closure(triples):
    known = set(triples)
    node = lambda x: not x.startswith('"')
    while True:
        out = set()
        kind = lambda k: {s for s, p, o in known if p == RDF_TYPE and o == OWL + k}  # noqa: E731, B023
        trans, sym, fun, inv = (kind(k) for k in ("TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty"))
        by_s = {}
        for t in known:
            by_s.setdefault(t[0], []).append(t)
        for s, p, o in known:
            after = by_s.get(o, [])
            out |= {(s, p, z) for _, q, z in after if q == p and p in {rs.SUB_CLASS, rs.SUB_PROPERTY} | trans}
            if p == RDF_TYPE:
                out |= {(s, p, z) for _, q, z in after if q == rs.SUB_CLASS}
            for _, q, z in by_s.get(p, []):
                out |= {(s, z, o)} if q == rs.SUB_PROPERTY else {(s, RDF_TYPE, z)} if q == rs.DOMAIN else set()
                if node(o):
                    out |= {(o, RDF_TYPE, z)} if q == rs.RANGE else {(o, z, s)} if q == rs.INVERSE_OF else set()
            if node(o):
                out |= {(o, q, s) for q, r, z in known if r == rs.INVERSE_OF and z == p}
                out |= {(o, p, s)} if p in sym else set()
                if p == rs.SAME and s != o:
                    out.add((o, p, s))
                    out |= {(s, p, z) for _, q, z in after if q == p and node(z) and z != s}
                    out |= {(o, q, z) for _, q, z in by_s.get(s, []) if q != p}
                    out |= {(x, q, o) for x, q, z in known if z == s and q != p}
            if p in fun and node(o):
                out |= {(o, rs.SAME, z) for _, q, z in by_s[s] if q == p and z != o and node(z)}
            if p in inv:
                out |= {(s, rs.SAME, x) for x, q, z in known if q == p and z == o and x != s}
        out = {t for t in out if t[1] != rs.SAME or t[0] != t[2]}
        if out <= known:
            return known
        known |= out


@pytest.mark.parametrize("seed", range(4))
def test_materialise_equals_a_plain_fixpoint(spark, seed):
    rng = random.Random(seed)
    things, props, classes = [f"x{i}" for i in range(9)], [f"p{i}" for i in range(5)], ["A", "B", "C"]
    triples = {(rng.choice(things), rng.choice(props), rng.choice([*things, '"lit"', '"other"'])) for _ in range(14)}
    triples |= {(rng.choice(things), RDF_TYPE, rng.choice(classes)), ("A", rs.SUB_CLASS, "B"), ("B", rs.SUB_CLASS, "C")}
    triples |= {(rng.choice(props), RDF_TYPE, OWL + k) for k in ("FunctionalProperty", "InverseFunctionalProperty", "TransitiveProperty", "SymmetricProperty")}
    triples |= {(props[0], rs.SUB_PROPERTY, props[1]), (props[1], rs.DOMAIN, "A"), (props[2], rs.RANGE, "B"), (props[3], rs.INVERSE_OF, props[4])}
    triples |= {("x0", rs.SAME, "x3"), (props[2], rs.SAME, "q"), ("x8", "q", "x7"), ("C", rs.SAME, "D")}
    if seed == 3:
        triples |= {(rs.SAME, rs.SUB_PROPERTY, "near"), ("p4", rs.SUB_PROPERTY, rs.SAME)}
    df = spark.createDataFrame([*sorted(triples), (None, "p0", "x1"), ("x1", "p0", None)], "s string, p string, o string")
    assert set(rows(rs.materialise(df.unionAll(df)))) == plain_closure(triples)


def test_a_large_class_is_not_listed_in_pairs(spark):
    n = 10_000
    t = spark.range(n).select(F.concat(F.lit("x"), F.lpad("id", 5, "0")).alias("s"), F.lit("key").alias("p"), F.lit("k").alias("o"))
    t = t.unionAll(spark.createDataFrame([("key", RDF_TYPE, OWL + "InverseFunctionalProperty"), ("x00007", "q", "x00009"), ("y", rs.SAME, "x09999")], t.schema))
    facts, members = rs.closure(t)
    assert members.count() == n + 1 and {r["rep"] for r in members.select("rep").distinct().collect()} == {"x00000"}
    assert set(rows(facts)) == {
        ("x00000", "key", "k"), ("key", RDF_TYPE, OWL + "InverseFunctionalProperty"), ("x00000", "q", "x00000"), ("x00000", rs.SAME, "x00000")
    }
    assert rs.with_names(facts.where("p = 'key'"), members).count() == n + 1
    assert rs.with_names(facts, members, "star").where(F.col("p") == rs.SAME).count() == n


def test_closure_of_nothing(spark):
    facts, members = rs.closure(spark.createDataFrame([], "s string, p string, o string"))
    assert facts.isEmpty() and members.isEmpty()


def test_facts_are_not_dealt_by_predicate(spark, monkeypatch):
    """Facts of one predicate meet the few axioms where they lie; no task gets all of them."""
    plans, cut = [], rs.cut

    def planned(df, label="state"):
        if label == "closure":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, label)

    monkeypatch.setattr(rs, "cut", planned)
    t = [("sold", rs.SUB_PROPERTY, "traded"), ("traded", rs.DOMAIN, "Seller")] + [(f"s{i * 7919}", "sold", f"x{i * 104729}") for i in range(4000)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20000)  # more than the axioms take, less than the facts
    try:
        facts = rs.materialise(spark.createDataFrame(t, "s string, p string, o string")).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert facts == 2 + 4000 * 3
    assert len(plans) > 1 and not any(re.search(r"SortMergeJoin \[p#\d+\], \[p#\d+\]", plan) for plan in plans)
