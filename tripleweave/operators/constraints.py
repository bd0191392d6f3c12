"""Data-quality tests compiled from an ontology and evaluated over triples, one join per kind of test.

Axioms become rows of a test table ``(test, target, cls, prop, low, high, value)``; data meet that table in joins and are
counted per target, so an ontology of any length costs the same number of passes. Triples are
``(s, p, o, o_is_literal)``, data triples may carry ``datatype``; the ontology needs ``(s, p, o)`` only.

| axiom | test | target | checked |
| --- | --- | --- | --- |
| ``rdfs:domain`` | domain | property | facts |
| ``rdfs:range`` a class | range | property | facts |
| ``rdfs:range`` a datatype | datatype | property | facts |
| ``xsd:pattern`` of a range | pattern | property | facts |
| functional, inverse functional | functional, inverse functional | property | subjects, objects with a value |
| asymmetric, irreflexive | asymmetric, irreflexive | property | facts |
| ``owl:propertyDisjointWith`` | disjoint properties | ``p q`` | facts of p |
| ``owl:disjointWith`` | disjoint | ``C D`` | members of C |
| ``owl:AllDisjointClasses`` | all disjoint | the axiom's node | members of any of its classes |
| restriction with a cardinality | min cardinality, max cardinality | ``C p`` | members of C |
| the same on ``rdfs:label`` | label | C | members of C |
| ``owl:allValuesFrom`` | all values | ``C p D`` | values of p of members of C |
| ``owl:someValuesFrom`` | some values | ``C p D`` | members of C |

A member of a class is a member of its superclasses. Repeated facts count once. A target without facts is reported 0 of 0.
A null subject, property or object is no fact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.schema import OWL, RDF_TYPE, RDFS
from tripleweave.plans.rounds import cut

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "test string, target string, cls string, prop string, low bigint, high bigint, value string"

# Lexical forms of XML Schema datatypes, by name.
LEXICAL = {
    "string": r"(?s).*",
    "boolean": r"true|false|0|1",
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "float": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "date": r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?",
    "dateTime": r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "time": r"[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gYear": r"-?[0-9]{4,}(Z|[+-][0-9]{2}:[0-9]{2})?",
    "anyURI": r"[^\s<>\"{}|\\^`]*",
    "nonNegativeInteger": r"\+?[0-9]+|-0+",
    "positiveInteger": r"\+?0*[1-9][0-9]*",
    "nonPositiveInteger": r"-[0-9]+|\+?0+",
    "negativeInteger": r"-0*[1-9][0-9]*",
    "long": r"[+-]?[0-9]+",
    "int": r"[+-]?[0-9]+",
}
# A datatype whose values are values of the other one too.
DERIVED = {
    "decimal": ["integer", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "long", "int"],
    "integer": ["nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "long", "int"],
    "nonNegativeInteger": ["positiveInteger"],
    "nonPositiveInteger": ["negativeInteger"],
    "long": ["int"],
}


def _axiom(o: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    """Axioms of one kind; ``o`` has each triple once."""
    return o.where(F.col("p") == predicate).select(F.col("s").alias(a), F.col("o").alias(b))


def _kind(o: DataFrame, name: str) -> DataFrame:
    return o.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + name)).select(F.col("s").alias("prop"))


def _number(col: str) -> Column:
    """A literal's number, written bare or as in N-Triples."""
    return F.regexp_extract(col, r'^"?([0-9]+)', 1).try_cast("bigint")


def closure(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b)``: everything reachable, by doubling path lengths. Circles are allowed."""
    known = cut(edges.select(a, b).distinct(), "closure")
    size = known.count()
    while size:
        far = known.join(known.select(F.col(a).alias(b), F.col(b).alias("_c")), b).select(a, F.col("_c").alias(b))
        known = cut(known.unionAll(far).distinct(), "closure")
        before, size = size, known.count()
        if size == before:
            break
    return known


def list_members(ontology: DataFrame) -> DataFrame:
    """``(head, member)`` of the RDF lists of a triple table."""
    rest = _axiom(ontology, RDF + "rest", "head", "cell").where(F.col("cell") != RDF + "nil")
    first = _axiom(ontology, RDF + "first", "cell", "member")
    cells = closure(rest, "head", "cell").unionAll(first.select(F.col("cell").alias("head"), "cell"))
    return cells.join(first, "cell").select("head", "member")


def compile_tests(ontology: DataFrame) -> DataFrame:
    """The test table of an ontology, written. Restrictions hold for the classes stated to be below or equal to them."""
    o = cut(ontology.select("s", "p", "o").dropna().distinct(), "ontology")
    none = F.lit(None)

    def row(df, test, target, cls=none, prop=none, low=none, high=none, value=none) -> DataFrame:
        test = F.lit(test) if isinstance(test, str) else test
        return df.select(
            test.alias("test"), target.alias("target"), cls.cast("string").alias("cls"), prop.cast("string").alias("prop"),
            low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), value.cast("string").alias("value"),
        )

    c = F.col
    pair = lambda *names: F.concat_ws(" ", *names)
    domain, range_ = _axiom(o, RDFS + "domain", "prop", "cls"), _axiom(o, RDFS + "range", "prop", "cls")
    members = cut(list_members(o), "list_members")
    # A datatype is one of XML Schema or a restriction of one.
    base = _axiom(o, OWL + "onDatatype", "cls", "base")
    facets = _axiom(o, OWL + "withRestrictions", "cls", "head").join(members, "head").select("cls", c("member").alias("facet"))
    patterns = facets.join(_axiom(o, XSD + "pattern", "facet", "value"), "facet").select("cls", F.regexp_replace("value", '^"(.*)"$', "$1").alias("value"))
    ranged = range_.join(base, "cls", "left").withColumn("base", F.coalesce("base", "cls"))
    is_data = c("base").startswith(XSD) | (c("base") == RDFS + "Literal")
    on = _axiom(o, OWL + "onProperty", "node", "prop")
    below = _axiom(o, RDFS + "subClassOf", "cls", "node").unionAll(_axiom(o, OWL + "equivalentClass", "cls", "node"))
    restricted = cut(on.join(below, "node").select("cls", "prop", "node"), "restrictions")
    bounds = [("minCardinality", True, False), ("maxCardinality", False, True), ("cardinality", True, True)]
    label = c("prop") == RDFS + "label"
    parts = [
        row(domain, "domain", c("prop"), c("cls"), c("prop")),
        row(ranged.where(~is_data), "range", c("prop"), c("cls"), c("prop")),
        row(ranged.where(is_data), "datatype", c("prop"), prop=c("prop"), value=c("base")),
        row(range_.join(patterns, "cls"), "pattern", c("prop"), prop=c("prop"), value=c("value")),
        row(_kind(o, "FunctionalProperty"), "functional", c("prop"), prop=c("prop"), high=F.lit(1)),
        row(_kind(o, "InverseFunctionalProperty"), "inverse functional", c("prop"), prop=c("prop"), high=F.lit(1)),
        row(_kind(o, "AsymmetricProperty"), "asymmetric", c("prop"), prop=c("prop")),
        row(_kind(o, "IrreflexiveProperty"), "irreflexive", c("prop"), prop=c("prop")),
        row(_axiom(o, OWL + "propertyDisjointWith", "prop", "q"), "disjoint properties", pair("prop", "q"), prop=c("prop"), value=c("q")),
        row(_axiom(o, OWL + "disjointWith", "cls", "d"), "disjoint", pair("cls", "d"), c("cls"), value=c("d")),
        row(_axiom(o, OWL + "members", "node", "head").join(members, "head"), "all disjoint", c("node"), c("member")),
    ]
    for name, lower, upper in bounds:
        bound = restricted.join(_axiom(o, OWL + name, "node", "n"), "node").withColumn("n", _number("n")).where("n IS NOT NULL")
        if lower:
            parts.append(row(bound, F.when(label, "label").otherwise("min cardinality"), F.when(label, c("cls")).otherwise(pair("cls", "prop")), c("cls"), c("prop"), low=c("n")))
        if upper:
            parts.append(row(bound, "max cardinality", pair("cls", "prop"), c("cls"), c("prop"), high=c("n")))
    for name, test in (("allValuesFrom", "all values"), ("someValuesFrom", "some values")):
        values = restricted.join(_axiom(o, OWL + name, "node", "d"), "node").where(~c("d").startswith(XSD))
        parts.append(row(values, test, pair("cls", "prop", "d"), c("cls"), c("prop"), low=F.lit(1), value=c("d")))
    return cut(reduce(DataFrame.unionAll, parts).distinct(), "tests")


def _fits(value: str, wanted: str) -> Column:
    """Whether a literal has the form a datatype asks for; an unknown datatype takes everything."""
    out = F.lit(True)
    for name, form in LEXICAL.items():
        out = F.when(F.col(wanted) == XSD + name, F.col(value).rlike(f"^(?:{form})$")).otherwise(out)
    whole = F.col(value).try_cast("decimal(38,0)")
    for name, bits in (("long", 63), ("int", 31)):
        out = out & (~(F.col(wanted) == XSD + name) | F.coalesce(whole.between(-(2**bits), 2**bits - 1), F.lit(False)))
    return out


def _declared(declared: str, wanted: str) -> Column:
    """Whether a declared datatype is the wanted one or derived from it; none, a foreign or an open one fits."""
    ok = F.col(declared).isNull() | ~F.col(declared).startswith(XSD) | (F.col(declared) == F.col(wanted)) | ~F.col(wanted).startswith(XSD)
    for name, below in DERIVED.items():
        ok = ok | ((F.col(wanted) == XSD + name) & F.col(declared).isin([XSD + b for b in below]))
    return ok


def _report(df: DataFrame, bad: Column, weight: Column | None = None) -> DataFrame:
    weight = F.lit(1) if weight is None else weight
    return df.groupBy("test", "target").agg(
        F.coalesce(F.sum(F.when(bad, weight)), F.lit(0)).cast("bigint").alias("violations"), F.sum(weight).cast("bigint").alias("checked")
    )


def evaluate_tests(triples: DataFrame, tests: DataFrame, ontology: DataFrame | None = None) -> DataFrame:
    """``(test, target, violations, checked)`` of every row of a test table.

    ``ontology`` gives the class hierarchy. Values are counted before they meet their classes, so a hub
    value is one row per test.
    """
    c = F.col
    if "datatype" not in triples.columns:
        triples = triples.withColumn("datatype", F.lit(None).cast("string"))
    known = triples.select("s", "p", "o", "o_is_literal", "datatype").dropna(subset=["s", "p", "o"])
    wanted = tests.select(c("prop").alias("p")).unionAll(tests.where("test = 'disjoint properties'").select(c("value").alias("p"))).distinct()
    facts = cut(known.join(wanted, "p", "left_semi").distinct(), "facts")
    named = tests.select("cls").unionAll(tests.select(c("value").alias("cls"))).dropna().distinct()
    types = known.where(c("p") == RDF_TYPE).select(c("s").alias("x"), c("o").alias("cls")).distinct()
    if ontology is not None:
        up = closure(_axiom(ontology.dropna(subset=["s", "p", "o"]), RDFS + "subClassOf", "cls", "_up"), "cls", "_up")
        types = types.unionAll(types.join(up, "cls").select("x", c("_up").alias("cls"))).distinct()
    types = cut(types.join(named, "cls", "left_semi"), "types")
    typed = types.withColumn("_ok", F.lit(True))
    of = lambda *kinds: tests.where(c("test").isin(*kinds))
    by_prop = lambda *kinds: facts.join(of(*kinds).withColumnRenamed("prop", "p"), "p")
    members = lambda *kinds: types.join(of(*kinds), "cls")
    found = []

    # Domain and range: the ends of facts, counted per test, meet the members of the class.
    ends = by_prop("domain", "range").select("test", "target", F.when(c("test") == "domain", c("s")).otherwise(c("o")).alias("x"), "cls")
    counted = ends.groupBy("test", "target", "x", "cls").agg(F.count("*").alias("n"))
    found.append(_report(counted.join(typed, ["x", "cls"], "left"), c("_ok").isNull(), c("n")))
    # Literals.
    literal = by_prop("datatype", "pattern")
    form = c("o_is_literal") & _fits("o", "value") & _declared("datatype", "value")
    # A pattern is matched as a whole, as XML Schema has it.
    whole = c("o_is_literal") & F.expr("o RLIKE concat('^(?:', value, ')$')")
    found.append(_report(literal, ~F.when(c("test") == "datatype", form).otherwise(whole)))
    # Values per subject, subjects per value.
    ends = by_prop("functional", "inverse functional").select(
        "test", "target", "high", F.when(c("test") == "functional", c("s")).otherwise(c("o")).alias("x"), F.when(c("test") == "functional", c("o")).otherwise(c("s")).alias("y")
    )
    found.append(_report(ends.groupBy("test", "target", "high", "x").agg(F.count_distinct("y").alias("n")), c("n") > c("high")))
    # Facts against facts.
    direct = by_prop("asymmetric", "irreflexive", "disjoint properties").select("test", "target", "p", "s", "o", "value").distinct()
    found.append(_report(direct.where("test = 'irreflexive'"), c("s") == c("o")))
    sought = direct.where("test <> 'irreflexive'").select(
        "test", "target", F.coalesce("value", "p").alias("p"), F.when(c("test") == "asymmetric", c("o")).otherwise(c("s")).alias("s"), F.when(c("test") == "asymmetric", c("s")).otherwise(c("o")).alias("o")
    )
    found.append(_report(sought.join(facts.select("s", "p", "o").distinct().withColumn("_ok", F.lit(True)), ["s", "p", "o"], "left"), c("_ok")))
    # Classes against classes.
    both = members("disjoint").select("test", "target", "x", c("value").alias("cls"))
    found.append(_report(both.join(typed, ["x", "cls"], "left"), c("_ok")))
    found.append(_report(members("all disjoint").groupBy("test", "target", "x").agg(F.count_distinct("cls").alias("n")), c("n") > 1))
    # Members with too few or too many values; all tests of this kind share the counts per subject.
    size = facts.groupBy(c("p").alias("prop"), c("s").alias("x")).agg(F.count_distinct("o").alias("n"))
    held = members("min cardinality", "max cardinality", "label").join(size, ["prop", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found.append(_report(held, (c("n") < F.coalesce("low", F.lit(0))) | (c("n") > c("high"))))
    # Members with values of a class.
    valued = members("all values", "some values").select("test", "target", "prop", "x", c("value").alias("cls"))
    values = valued.join(facts.select(c("p").alias("prop"), c("s").alias("x"), c("o").alias("y")).distinct(), ["prop", "x"], "left")
    values = values.join(types.select(c("x").alias("y"), "cls", F.lit(True).alias("_ok")), ["y", "cls"], "left")
    found.append(_report(values.where("test = 'all values' AND y IS NOT NULL"), c("_ok").isNull()))
    some = values.where("test = 'some values'").groupBy("test", "target", "x").agg(F.count("_ok").alias("n"))
    found.append(_report(some, c("n") == 0))

    result = reduce(DataFrame.unionAll, found)
    zero = F.lit(0).cast("bigint")
    return tests.select("test", "target").distinct().join(result, ["test", "target"], "left").select(
        "test", "target", F.coalesce("violations", zero).alias("violations"), F.coalesce("checked", zero).alias("checked")
    )


def validate(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """``(test, target, violations, checked)`` of the tests that follow from an ontology."""
    return evaluate_tests(triples, compile_tests(ontology), ontology)
