"""Schema and ontology matching."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import text as tx
from tripleweave.operators.cluster import unique_mapping
from tripleweave.plans.rounds import cut


def cells(df: DataFrame, table: str) -> DataFrame:
    """``(table, column, value)`` of a wide table, all values as strings."""
    text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    return text.unpivot([], df.columns, "column", "value").select(F.lit(table).alias("table"), "column", "value")


def near_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs ``(v1, v2)`` of one-column value tables with edit distance <= max(len) / 5.

    Exact, without comparing all values: cut the longer string into tau + 1 pieces, tau the
    edits allowed; one piece must occur unchanged in the shorter string, moved by no more
    than the edits on either side of it permit. Piece and place make the join key.
    """

    def pieces(df: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        return (
            df.select(name, n.alias("_ll"), F.expr(f"length({name}) div 5").alias("_tau"))
            .select(name, "_ll", "_tau", F.explode(F.sequence(F.lit(0), F.col("_tau").cast("int"))).alias("_i"))
            .selectExpr(name, "_ll", "_i", "cast(_i * _ll div (_tau + 1) as int) _s", "cast((_i + 1) * _ll div (_tau + 1) as int) _e")
            .select(name, "_ll", "_i", F.substring(F.col(name), F.col("_s") + 1, F.col("_e") - F.col("_s")).alias("_piece"))
        )

    def places(df: DataFrame, name: str, strictly: bool) -> DataFrame:
        first = F.length(name) + (1 if strictly else 0)
        rows = (
            df.select(name, F.length(name).alias("_ls"), F.explode(F.sequence(first, F.greatest(first, F.expr(f"cast(length({name}) * 5 div 4 + 1 as int)")))).alias("_ll"))
            .withColumn("_tau", F.expr("cast(_ll div 5 as int)"))
            .where("_ll - _tau <= _ls")
            .select("*", F.explode(F.sequence(F.lit(0), F.col("_tau"))).alias("_i"))
            .selectExpr("*", "cast(_i * _ll div (_tau + 1) as int) _s", "cast((_i + 1) * _ll div (_tau + 1) as int) _e")
            .selectExpr(
                "*",
                "greatest(0, _s - _i, _s + _ls - _ll - (_tau - _i)) _lo",
                "least(_ls - (_e - _s), _s + _i, _s + _ls - _ll + (_tau - _i)) _hi",
            )
            .where("_lo <= _hi")
        )
        return rows.select(
            name, "_ll", "_i", F.explode(F.sequence("_lo", "_hi")).alias("_p"), (F.col("_e") - F.col("_s")).alias("_n")
        ).select(name, "_ll", "_i", F.substring(F.col(name), F.col("_p") + 1, F.col("_n")).alias("_piece")).distinct()

    left, right = a.toDF("v1").where("length(v1) > 0"), b.toDF("v2").where("length(v2) > 0")
    keys = ["_ll", "_i", "_piece"]
    found = (
        pieces(left, "v1").join(places(right, "v2", False), keys).select("v1", "v2")
        .unionAll(pieces(right, "v2").join(places(left, "v1", True), keys).select("v1", "v2"))
        .distinct()
    )
    return found.where(F.levenshtein("v1", "v2") * 5 <= F.greatest(F.length("v1"), F.length("v2")))


def match_cells_jaccard(a: DataFrame, b: DataFrame, threshold: float = 0.0, fuzzy: bool = False) -> DataFrame:
    """Column pairs of all table pairs scored by the Jaccard of their value sets."""
    keys = ["table", "column"]
    left, right = a.select(*keys, "value").distinct(), b.select(*keys, "value").distinct()
    left, right = left.where("value IS NOT NULL"), right.where("value IS NOT NULL")
    n1 = left.groupBy(F.col("table").alias("table_1"), F.col("column").alias("column_1")).agg(F.count("*").alias("n1"))
    n2 = right.groupBy(F.col("table").alias("table_2"), F.col("column").alias("column_2")).agg(F.count("*").alias("n2"))
    l = left.select(F.col("table").alias("table_1"), F.col("column").alias("column_1"), F.col("value").alias("v1"))
    r = right.select(F.col("table").alias("table_2"), F.col("column").alias("column_2"), F.col("value").alias("v2"))
    by = ["table_1", "column_1", "table_2", "column_2"]
    if fuzzy:
        near = near_values(left.select("value").distinct(), right.select("value").distinct())
        joined = near.join(l, "v1").join(r, "v2")
        counts = joined.groupBy(*by).agg(F.count_distinct("v1").alias("s1"), F.count_distinct("v2").alias("s2"))
    else:
        counts = l.join(r, F.col("v1") == F.col("v2")).groupBy(*by).agg(F.count("*").alias("s1"))
        counts = counts.withColumn("s2", F.col("s1"))
    shared = F.when(F.col("n1") <= F.col("n2"), F.col("s1")).otherwise(F.col("s2"))
    return (
        counts.join(n1, ["table_1", "column_1"]).join(n2, ["table_2", "column_2"])
        .select(*by, (shared / (F.col("n1") + F.col("n2") - shared)).alias("score"))
        .where(F.col("score") > threshold)
    )


def match_columns_jaccard(a: DataFrame, b: DataFrame, threshold: float = 0.0, fuzzy: bool = False) -> DataFrame:
    """``(column_1, column_2, score)`` of two tables."""
    out = match_cells_jaccard(cells(a, "1"), cells(b, "2"), threshold, fuzzy)
    return out.select("column_1", "column_2", "score")


# --- names and types -------------------------------------------------------------------


def _name_tokens(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [t.lower() for t in re.split(r"[^A-Za-z0-9]+", spaced) if t] or [name.lower()]


def _token_similarity(x: Column, y: Column) -> Column:
    shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    affix = F.startswith(x, y) | F.startswith(y, x) | F.endswith(x, y) | F.endswith(y, x)
    return F.when(x == y, F.lit(1.0)).otherwise(
        F.greatest(F.when(affix, shorter / longer).otherwise(F.lit(0.0)), tx.edit_similarity(x, y))
    )


def _name_similarity(a: Column, b: Column) -> Column:
    best = lambda p, q: F.transform(p, lambda x: F.array_max(F.transform(q, lambda y: _token_similarity(x, y))))
    total = F.aggregate(F.concat(best(a, b), best(b, a)), F.lit(0.0), lambda s, v: s + v)
    return total / (F.size(a) + F.size(b))


def _type_classes(df: DataFrame) -> DataFrame:
    """One row: per column integer, number, date or text, judged on all its values."""

    def kind(c: str) -> Column:
        v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        holds = lambda t: F.count(v.try_cast(t)) == F.count(v)
        return F.when(F.count(v) == 0, "text").when(holds("bigint"), "integer").when(holds("double"), "number").when(
            holds("date"), "date"
        ).otherwise("text").alias(c)

    return df.agg(*[kind(c) for c in df.columns])


def match_columns_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column_1, column_2, score)``: half linguistic, half structural similarity.

    Linguistic: mean best token similarity of the names. Structural: 0.5 for the same value
    type, 0.3 for the same family, plus half the mean best name similarity of the tables. The
    pairs are those of two schemas, known when the plan is built.
    """
    ta = _type_classes(a).select(F.struct(*a.columns).alias("a"))
    tb = _type_classes(b).select(F.struct(*b.columns).alias("b"))
    tokens = lambda n: F.array(*[F.lit(t) for t in _name_tokens(n)])
    by_column = lambda n, t: F.struct(F.lit(n).alias("name"), tokens(n).alias("tokens"), t.alias("type"))
    left = ta.select(F.explode(F.array(*[by_column(c, F.col("a")[c]) for c in a.columns])).alias("l"), F.lit(1).alias("_k"))
    right = tb.select(F.array(*[by_column(c, F.col("b")[c]) for c in b.columns]).alias("rs"), F.lit(1).alias("_k"))
    pairs = left.join(right, "_k").select("l", F.explode("rs").alias("r"))
    scored = pairs.select(
        F.col("l.name").alias("column_1"), F.col("r.name").alias("column_2"),
        _name_similarity(F.col("l.tokens"), F.col("r.tokens")).alias("_ling"),
        F.when(F.col("l.type") == F.col("r.type"), 0.5)
        .when(F.col("l.type").isin("integer", "number") & F.col("r.type").isin("integer", "number"), 0.3)
        .otherwise(0.0).alias("_type"),
    )
    best = F.max("_ling").over(Window.partitionBy("column_1"))
    mean = F.avg("_best").over(Window.partitionBy())
    return scored.withColumn("_best", best).select(
        "column_1", "column_2", (0.5 * F.col("_ling") + 0.5 * (F.col("_type") + 0.5 * mean)).alias("score")
    )


def one_to_one(scores: DataFrame, left: str = "column_1", right: str = "column_2") -> DataFrame:
    """Greedy one-to-one subset of the scores at or above their median."""
    table = scores.select(F.col(left).alias("id_1"), F.col(right).alias("id_2"), F.col("score").alias("weight"))
    # The median of per-column-pair scores: as many values as there are column pairs.
    median = table.agg(F.median("weight").alias("m")).scalar()
    chosen = unique_mapping(table.where(F.col("weight") >= median), -1.0)
    return chosen.select(F.col("id_1").alias(left), F.col("id_2").alias(right), F.col("weight").alias("score"))


# --- ontologies ------------------------------------------------------------------------

# Vocabulary IRIs.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
CLASS_KINDS = [OWL + "Class", RDFS + "Class"]
PROPERTY_KINDS = [
    OWL + "ObjectProperty", OWL + "DatatypeProperty", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property",
]


def _terms(onto: DataFrame) -> DataFrame:
    """``(iri, kind, label)`` of the named classes and properties."""
    kind = F.when(F.col("o").isin(*CLASS_KINDS), "class").when(F.col("o").isin(*PROPERTY_KINDS), "property")
    named = onto.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("iri"), kind.alias("kind")).where("kind IS NOT NULL").distinct()
    labels = onto.where(F.col("p") == RDFS + "label").groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))
    return named.join(labels, "iri", "left").select("iri", "kind", F.coalesce("label", tx.local_name(F.col("iri"))).alias("label"))


def align_ontologies(o1: DataFrame, o2: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``(e1, e2, score)``: one-to-one alignment of classes and of properties.

    Candidates share a label word; the lexical score is the better of word Jaccard and edit
    similarity, and a quarter of the final score comes from the best pair of parents.
    """
    def words_of(onto: DataFrame, i: int) -> DataFrame:
        return _terms(onto).select(
            F.col("iri").alias(f"e{i}"), "kind", F.lower("label").alias(f"l{i}"), tx.tokens(F.col("label")).alias(f"t{i}")
        )

    w1, w2 = words_of(o1, 1), words_of(o2, 2)
    key = lambda w, i: w.select(f"e{i}", "kind", F.explode(f"t{i}").alias("_w"))
    candidates = key(w1, 1).join(key(w2, 2), ["kind", "_w"]).select("e1", "e2").distinct()
    lexical = cut(
        candidates.join(w1, "e1").join(w2.drop("kind"), "e2").select(
            "e1", "e2", F.greatest(tx.set_jaccard(F.col("t1"), F.col("t2")), tx.edit_similarity(F.col("l1"), F.col("l2"))).alias("lex")
        ),
        "lexical",
    )
    up = lambda o, i: o.where(F.col("p").isin(RDFS + "subClassOf", RDFS + "subPropertyOf")).select(
        F.col("s").alias(f"e{i}"), F.col("o").alias(f"p{i}")
    )
    parents = (
        lexical.select("e1", "e2").join(up(o1, 1), "e1").join(up(o2, 2), "e2")
        .join(lexical.select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("lex").alias("_up")), ["p1", "p2"], "left")
        .groupBy("e1", "e2").agg(F.max(F.coalesce("_up", F.lit(0.0))).alias("up"))
    )
    scored = lexical.join(parents, ["e1", "e2"], "left").select(
        "e1", "e2", (0.75 * F.col("lex") + 0.25 * F.coalesce("up", "lex")).alias("score")
    ).where(F.col("score") >= threshold)
    chosen = unique_mapping(scored.select(F.col("e1").alias("id_1"), F.col("e2").alias("id_2"), F.col("score").alias("weight")), 0.0)
    return chosen.select(F.col("id_1").alias("e1"), F.col("id_2").alias("e2"), F.col("weight").alias("score"))
