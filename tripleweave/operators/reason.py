"""Rule-based closure and contradictions over triples ``(s, p, o)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.cluster import connected_components
from tripleweave.operators.schema import OWL, RDF_TYPE, RDFS
from tripleweave.plans.rounds import cut

SUB_CLASS, SUB_PROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
DOMAIN, RANGE = RDFS + "domain", RDFS + "range"
SAME, DIFFERENT, INVERSE_OF = OWL + "sameAs", OWL + "differentFrom", OWL + "inverseOf"


def _where(t: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    return t.where(F.col("p") == predicate).select(F.col("s").alias(a), F.col("o").alias(b))


def _typed(t: DataFrame, kind: str, name: str = "p") -> DataFrame:
    return t.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + kind)).select(F.col("s").alias(name)).distinct()


def _triple(df: DataFrame, s, p, o) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(s).alias("s"), col(p).alias("p"), col(o).alias("o"))


KINDS = [OWL + k for k in ("TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty")]
NODE = "NOT startswith(o, '\"')"  # a literal is no subject


def _named(facts: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Every representative in ``column`` under each of its names."""
    names = members.select(F.col("rep").alias(column), F.col("node").alias("_n"))
    return facts.join(names, column, "left").withColumn(column, F.coalesce("_n", column)).select("s", "p", "o")


def _represented(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Subjects and objects by their representatives; equality of a class is one fact, the representative with itself."""
    rows = facts.where((F.col("p") != SAME) | ~F.expr(NODE))
    for column in ("s", "o"):
        reps = members.select(F.col("node").alias(column), F.col("rep").alias("_r"))
        rows = rows.join(reps, column, "left").withColumn(column, F.coalesce("_r", column)).drop("_r")
    equal = members.select(F.col("rep").alias("s"), F.lit(SAME).alias("p"), F.col("rep").alias("o"))
    return rows.select("s", "p", "o").unionAll(equal).distinct()


def _schema(facts: DataFrame, members: DataFrame | None) -> DataFrame:
    """Axioms about properties. A predicate keeps its own name in facts, so here properties stand under all their names."""
    if members is None:
        return facts.where(F.col("p").isin(SUB_PROPERTY, INVERSE_OF, DOMAIN, RANGE) | ((F.col("p") == RDF_TYPE) & F.col("o").isin(KINDS)))
    properties = _named(_named(facts.where(F.col("p").isin(SUB_PROPERTY, INVERSE_OF)), members, "s"), members, "o")
    typed = _named(facts.where(F.col("p").isin(DOMAIN, RANGE)), members, "s")
    kinds = facts.where(F.col("p") == RDF_TYPE).join(
        members.where(F.col("node").isin(KINDS)).select(F.col("rep").alias("o"), F.col("node").alias("_n")), "o", "left"
    ).withColumn("o", F.coalesce("_n", "o")).where(F.col("o").isin(KINDS)).select("s", "p", "o")
    return properties.unionAll(typed).unionAll(_named(kinds, members, "s")).distinct()


def _derive(new: DataFrame, known: DataFrame, new_axioms: DataFrame, axioms: DataFrame) -> DataFrame:
    """Conclusions over representatives with a premise in ``new`` (``new_axioms``); the known tables include the new ones."""
    type_, same = F.lit(RDF_TYPE), F.lit(SAME)
    out = []

    def both(rule):
        out.extend([rule(new, known), rule(known, new)])

    def by_axiom(rule):
        out.extend([rule(new, axioms), rule(known, new_axioms)])

    # Class and property hierarchies.
    both(lambda a, b: _triple(_where(a, SUB_CLASS, "x", "y").join(_where(b, SUB_CLASS, "y", "z"), "y"), "x", F.lit(SUB_CLASS), "z"))
    both(lambda a, b: _triple(_where(a, SUB_PROPERTY, "x", "y").join(_where(b, SUB_PROPERTY, "y", "z"), "y"), "x", F.lit(SUB_PROPERTY), "z"))
    both(lambda a, b: _triple(_where(a, RDF_TYPE, "x", "c").join(_where(b, SUB_CLASS, "c", "d"), "c"), "x", type_, "d"))
    by_axiom(lambda a, b: _triple(a.join(_where(b, SUB_PROPERTY, "p", "q"), "p"), "s", "q", "o"))
    by_axiom(lambda a, b: _triple(a.join(_where(b, DOMAIN, "p", "c"), "p"), "s", type_, "c"))
    by_axiom(lambda a, b: _triple(a.where(NODE).join(_where(b, RANGE, "p", "c"), "p"), "o", type_, "c"))
    # Property characteristics.
    by_axiom(lambda a, b: _triple(a.where(NODE).join(_where(b, INVERSE_OF, "p", "q"), "p"), "o", "q", "s"))
    by_axiom(lambda a, b: _triple(a.where(NODE).join(_where(b, INVERSE_OF, "q", "p"), "p"), "o", "q", "s"))
    by_axiom(lambda a, b: _triple(a.where(NODE).join(_typed(b, "SymmetricProperty"), "p"), "o", "p", "s"))
    step = lambda t: t.select(F.col("p").alias("_p"), F.col("s").alias("y"), F.col("o").alias("z"))
    trans = _typed(axioms, "TransitiveProperty")
    both(lambda a, b: _triple(a.join(trans, "p").join(step(b), F.expr("o = y AND p = _p")), "s", "p", "z"))
    # A property may itself be found to be transitive.
    out.append(_triple(known.join(_typed(new_axioms, "TransitiveProperty"), "p").join(step(known), F.expr("o = y AND p = _p")), "s", "p", "z"))
    functional, inverse = _typed(axioms, "FunctionalProperty"), _typed(axioms, "InverseFunctionalProperty")
    # A functional subject equates its objects: each with the smallest, so a star, not all pairs.
    for group, member, kind in (("s", "o", functional), ("o", "s", inverse)):
        facts = known.join(kind, "p").where(f"NOT startswith({member}, '\"')")
        first = facts.groupBy("p", group).agg(F.min(member).alias("_m"))
        out.append(_triple(facts.join(first, ["p", group]).where(F.col(member) != F.col("_m")), "_m", same, member))
    rows = out[0]
    for d in out[1:]:
        rows = rows.unionAll(d)
    return rows


def _is_link() -> Column:
    return (F.col("p") == SAME) & F.expr(NODE) & (F.col("s") != F.col("o"))


def closure(triples: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """``(facts, members)``: the closure with one representative, the least name, per class of equal nodes.

    ``members`` is ``(node, rep)`` of all classes of two and more. ``facts`` is ``(s, p, o)`` with
    representatives as subjects and objects (predicates as they are), so a fact about a class of n
    nodes is one row, not n, and the class itself has n rows, not n * n. ``with_names`` writes the names
    out, for all facts or for those somebody asks for.

    Semi-naive: a round derives from what the round before found. When classes merge, facts are
    renamed and the renamed ones count as new. Statements that something equals itself are not derived.
    """
    given = cut(triples.select("s", "p", "o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct(), "closure")
    members, axioms = None, given.limit(0)
    parts, known = [], given.limit(0)
    new, links = given, given.where(_is_link()).count()
    for _ in range(max_rounds):
        if links:
            edges = new.where(_is_link()).select(F.col("s").alias("id_1"), F.col("o").alias("id_2"), F.lit(1.0).alias("weight"))
            if members is not None:
                edges = edges.unionAll(members.where("node <> rep").select("node", "rep", F.lit(1.0)))
            members = cut(connected_components(edges).select(F.col("id").alias("node"), F.col("cluster").alias("rep")), "equal")
            renamed = cut(_represented(known.unionAll(new), members), "closure")
            new = cut(renamed.join(known, ["s", "p", "o"], "left_anti"), "closure")
            parts, known = [renamed], renamed
            before, axioms = axioms, cut(_schema(known, members), "axioms")
            new_axioms = cut(axioms.join(before, ["s", "p", "o"], "left_anti"), "axioms")
        else:
            parts.append(new)
            known = known.unionAll(new)
            if len(parts) % 8 == 0:
                known = cut(known, "closure")  # keep the scan list short
            # Written: the planner sees how few axioms there are, and facts are not dealt by their predicate to meet them.
            axioms, new_axioms = cut(_schema(known, members), "axioms"), cut(_schema(new, members), "axioms")
        derived = _derive(new, known, new_axioms, axioms).distinct()
        new = cut(derived.join(known, ["s", "p", "o"], "left_anti").where((F.col("p") != SAME) | (F.col("s") != F.col("o"))), "closure")
        found, links = new.agg(F.count("*"), F.count(F.when(_is_link(), 1))).first()
        if not found:
            return known, given.select(F.col("s").alias("node"), F.col("s").alias("rep")).limit(0) if members is None else members
    raise RuntimeError("closure: still deriving after max_rounds")


def with_names(facts: DataFrame, members: DataFrame, equalities: str = "all") -> DataFrame:
    """Facts of a closure under all names of their nodes; filter ``facts`` first to name only those.

    Equal nodes are listed as all ordered pairs, or with ``equalities="star"`` each with its representative.
    """
    equal = (F.col("p") == SAME) & (F.col("s") == F.col("o"))
    plain = _named(_named(facts.where(~equal), members, "s"), members, "o")
    classes = facts.where(equal)
    if equalities == "star":
        return plain.unionAll(_named(classes, members, "s").where("s <> o"))
    return plain.unionAll(_named(_named(classes, members, "s"), members, "o").where("s <> o"))


def materialise(triples: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Closure under hierarchy, domain/range, property characteristics and sameAs, all names written out.

    Literal objects are in quotes and are never subjects. A class of n equal nodes has n * (n - 1) rows here;
    ``closure`` holds the same without them. Triples with a null are left out.
    """
    full = with_names(*closure(triples, max_rounds))
    given = triples.select("s", "p", "o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    return full.unionAll(given.where((F.col("p") == SAME) & (F.col("s") == F.col("o"))).distinct())


def inconsistencies(triples: DataFrame) -> DataFrame:
    """``(rule, subject, detail)`` of a closed triple set."""
    t = triples.select("s", "p", "o")
    members = _where(t, RDF_TYPE, "x", "c")
    disjoint = _where(t, OWL + "disjointWith", "c", "d")
    row = lambda df, rule, s, detail: df.select(F.lit(rule).alias("rule"), F.col(s).alias("subject"), F.col(detail).alias("detail"))
    parts = [
        row(members.join(disjoint, "c").join(members.select("x", F.col("c").alias("d")), ["x", "d"]), "disjoint classes", "x", "d"),
        row(t.join(_typed(t, "IrreflexiveProperty"), "p").where("s = o"), "irreflexive property", "s", "p"),
        row(
            t.join(_typed(t, "AsymmetricProperty"), "p").join(t.select(F.col("o").alias("s"), "p", F.col("s").alias("o")), ["s", "p", "o"], "left_semi"),
            "asymmetric property", "s", "p",
        ),
        row(_where(t, SAME, "x", "y").join(_where(t, DIFFERENT, "x", "y"), ["x", "y"]), "same and different", "x", "y"),
        row(members.where(F.col("c") == OWL + "Nothing"), "member of nothing", "x", "c"),
        row(_functional_conflicts(t), "functional with different values", "s", "p"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def _functional_conflicts(t: DataFrame) -> DataFrame:
    """Subjects with two values of a functional property that are stated to differ."""
    f = t.join(_typed(t, "FunctionalProperty"), "p")
    differ = _where(t, DIFFERENT, "o", "o2")
    return f.join(differ, "o").join(t.select("s", "p", F.col("o").alias("o2")), ["s", "p", "o2"], "left_semi").select("s", "p")
