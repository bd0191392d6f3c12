"""Tests that follow from an ontology, on literal triples."""

from conftest import rows

from tripleweave.operators import constraints as cs
from tripleweave.operators.schema import OWL, RDF_TYPE, RDFS

X, RDF = cs.XSD, cs.RDF
FACTS = "s string, p string, o string, o_is_literal boolean, datatype string"


def triples(spark, data):
    return spark.createDataFrame([(s, p, o, lit, d) for s, p, o, lit, d in data], FACTS)


def ontology(spark, data):
    return spark.createDataFrame(data, "s string, p string, o string")


def is_a(x, c):
    return (x, RDF_TYPE, c, False, None)


def test_domain_follows_the_hierarchy_and_circles_end(spark):
    onto = ontology(spark, [("p", RDFS + "domain", "A"), ("B", RDFS + "subClassOf", "C"), ("C", RDFS + "subClassOf", "A"), ("A", RDFS + "subClassOf", "B")])
    data = triples(spark, [is_a("x", "B"), ("x", "p", "1", True, None), ("x", "p", "1", True, None), ("y", "p", "2", True, None)])
    assert rows(cs.validate(data, onto)) == [("domain", "p", 1, 2)]


def test_literals_have_form_and_datatype(spark):
    onto = ontology(spark, [("n", RDFS + "range", X + "integer"), ("d", RDFS + "range", X + "date"), ("i", RDFS + "range", X + "int"), ("u", RDFS + "range", X + "unheardOf")])
    data = triples(spark, [
        ("a", "n", "12", True, None), ("b", "n", "12", True, X + "string"), ("c", "n", "-7", True, X + "long"), ("d", "n", "1.5", True, None), ("e", "n", "urn:x", False, None),
        ("a", "d", "2020-01-31", True, None), ("b", "d", "31.1.2020", True, None), ("a", "i", "3000000000", True, None), ("b", "i", "3", True, None), ("a", "u", "?", True, None),
    ])
    assert rows(cs.validate(data, onto)) == [("datatype", "d", 1, 2), ("datatype", "i", 1, 2), ("datatype", "n", 3, 5), ("datatype", "u", 0, 1)]


def test_patterns_of_a_restricted_datatype_match_whole_values(spark):
    onto = ontology(spark, [
        ("code", RDFS + "range", "T"), ("T", OWL + "onDatatype", X + "string"), ("T", OWL + "withRestrictions", "l1"), ("l1", RDF + "first", "f1"), ("l1", RDF + "rest", "l2"),
        ("l2", RDF + "first", "f2"), ("l2", RDF + "rest", RDF + "nil"), ("f1", X + "minLength", "1"), ("f2", X + "pattern", '"[A-Z]|[0-9]"'),
    ])
    data = triples(spark, [("a", "code", "Q", True, None), ("b", "code", "Q1", True, None), ("c", "code", "7", True, None)])
    assert rows(cs.validate(data, onto)) == [("datatype", "code", 0, 3), ("pattern", "code", 1, 3)]


def restriction(i, cls, prop, kind, value):
    return [(cls, RDFS + "subClassOf", f"r{i}"), (f"r{i}", OWL + "onProperty", prop), (f"r{i}", OWL + kind, value)]


def test_cardinalities_count_distinct_values_of_members(spark):
    onto = ontology(spark, restriction(1, "A", "p", "minCardinality", "1") + restriction(2, "A", "p", "maxCardinality", '"1"^^<x>') + restriction(3, "A", RDFS + "label", "minCardinality", "1"))
    data = triples(spark, [is_a("x", "A"), is_a("y", "A"), is_a("z", "A"), ("x", "p", "1", True, None), ("x", "p", "2", True, None), ("y", "p", "1", True, None), ("y", "p", "1", True, X + "int"), ("o", "p", "1", True, None), ("x", RDFS + "label", "x", True, None)])
    assert rows(cs.validate(data, onto)) == [("label", "A", 2, 3), ("max cardinality", "A p", 1, 3), ("min cardinality", "A p", 1, 3)]


def test_values_of_a_class(spark):
    onto = ontology(spark, restriction(1, "A", "p", "allValuesFrom", "D") + restriction(2, "A", "p", "someValuesFrom", "D"))
    data = triples(spark, [is_a("x", "A"), is_a("y", "A"), is_a("d", "D"), ("x", "p", "d", False, None), ("x", "p", "e", False, None)])
    assert rows(cs.validate(data, onto)) == [("all values", "A p D", 1, 2), ("some values", "A p D", 1, 2)]


def test_properties_against_facts(spark):
    onto = ontology(spark, [("p", RDF_TYPE, OWL + k) for k in ("FunctionalProperty", "InverseFunctionalProperty", "AsymmetricProperty", "IrreflexiveProperty")] + [("p", OWL + "propertyDisjointWith", "q")])
    data = triples(spark, [("a", "p", "b", False, None), ("b", "p", "a", False, None), ("a", "p", "a", False, None), ("a", "q", "b", False, None)])
    assert rows(cs.validate(data, onto)) == [("asymmetric", "p", 3, 3), ("disjoint properties", "p q", 1, 3), ("functional", "p", 1, 2), ("inverse functional", "p", 1, 2), ("irreflexive", "p", 1, 3)]


def test_disjoint_classes_in_pairs_and_lists(spark):
    onto = ontology(spark, [("A", OWL + "disjointWith", "B"), ("d", OWL + "members", "l1"), ("l1", RDF + "first", "A"), ("l1", RDF + "rest", "l2"), ("l2", RDF + "first", "B"), ("l2", RDF + "rest", "l3"), ("l3", RDF + "first", "C"), ("l3", RDF + "rest", RDF + "nil")])
    data = triples(spark, [is_a("x", "A"), is_a("x", "B"), is_a("y", "A"), is_a("z", "C"), is_a("z", "B")])
    assert rows(cs.validate(data, onto)) == [("all disjoint", "d", 2, 3), ("disjoint", "A B", 1, 2)]


def test_empty_data_and_nulls(spark):
    onto = ontology(spark, [("p", RDFS + "domain", "A"), ("p", RDFS + "range", X + "date"), (None, RDFS + "range", "A")])
    data = triples(spark, [(None, "p", "x", True, None), ("s", None, "x", True, None), ("s", "p", None, True, None)])
    zero = [("datatype", "p", 0, 0), ("domain", "p", 0, 0)]
    assert rows(cs.validate(data, onto)) == zero and rows(cs.validate(data.limit(0), onto)) == zero
    assert cs.validate(data, onto.limit(0)).count() == 0
