"""Tables to triples, mapping rules, graph views, label suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.functions import text as tx
from tripleweave.operators.schema import RDF_TYPE, RDFS


def table_to_triples(df: DataFrame, subject_col: str, base_uri: str, drop_empty: bool = False) -> DataFrame:
    """``(s, p, o, o_is_literal)``: one literal triple per cell; blanks stay unless dropped."""
    rest = [c for c in df.columns if c != subject_col]
    text = df.select(F.col(subject_col).cast("string").alias("_id"), *[F.col(c).cast("string").alias(c) for c in rest])
    cells = text.unpivot(["_id"], rest, "_column", "o")
    if drop_empty:
        cells = cells.where("o IS NOT NULL AND o <> ''")
    return cells.select(
        F.concat(F.lit(base_uri), "_id").alias("s"), F.concat(F.lit(base_uri), "_column").alias("p"),
        F.coalesce("o", F.lit("")).alias("o"), F.lit(True).alias("o_is_literal"),
    ).distinct()


# --- mapping rules ---------------------------------------------------------------------


def template(pattern: str, prefix: str = "") -> Column:
    """``urn:x/{col}`` as a Column; NULL if a column is NULL."""
    pieces = re.split(r"\{([^{}]+)\}", pattern)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(prefix + p).cast("string") for i, p in enumerate(pieces) if p or i % 2])


def _term(spec: dict, prefix: str = "") -> Column:
    if "constant" in spec:
        return F.lit(spec["constant"])
    if "template" in spec:
        return template(spec["template"], prefix)
    if "column" in spec:
        return F.col(prefix + spec["column"]).cast("string")
    raise ValueError(f"an object needs constant, template, column or parent: {spec}")


def map_to_triples(sources: dict[str, DataFrame], mapping: list[dict]) -> DataFrame:
    """``(s, p, o, o_is_literal, datatype, lang)`` from mapping rules.

    A rule is ``{"name", "source", "subject", "classes", "objects"}``; an object names its
    ``predicate`` and a ``constant``, ``template`` or ``column`` (literal unless it is a
    template or ``"iri": True``), with ``datatype`` or ``lang``; or a ``parent`` rule with the
    ``join`` columns ``{child: parent}``. Rows with a NULL part yield no triple.
    """
    rules = {r["name"]: r for r in mapping}
    out = None

    def emit(df: DataFrame, p: Column, o: Column, literal: bool, datatype=None, lang=None) -> None:
        nonlocal out
        part = df.select(
            F.col("_s").alias("s"), p.alias("p"), o.alias("o"), F.lit(literal).alias("o_is_literal"),
            F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"),
        ).where("s IS NOT NULL AND o IS NOT NULL")
        out = part if out is None else out.unionByName(part)

    for rule in mapping:
        rows = sources[rule["source"]].withColumn("_s", template(rule["subject"]))
        for cls in rule.get("classes", []):
            emit(rows, F.lit(RDF_TYPE), F.lit(cls), False)
        for obj in rule.get("objects", []):
            p = F.lit(obj["predicate"])
            if "parent" in obj:
                parent = rules[obj["parent"]]
                keys = obj["join"]
                right = sources[parent["source"]].select(
                    template(parent["subject"]).alias("_o"), *[F.col(pc).alias(f"_k{i}") for i, pc in enumerate(keys.values())]
                )
                on = [rows[c] == right[f"_k{i}"] for i, c in enumerate(keys)]
                emit(rows.join(right, on), p, F.col("_o"), False)
            else:
                literal = not (obj.get("iri") or "template" in obj)
                emit(rows, p, _term(obj), literal, obj.get("datatype"), obj.get("lang"))
    return out.distinct()


# --- graph view ------------------------------------------------------------------------


def graph_nodes(triples: DataFrame) -> DataFrame:
    """``(id, literal, value, class_uri, label, display)``; a literal object is its own node.

    Class and label are the greatest values stated, the display name is the label, the
    literal value or the last part of the IRI.
    """
    is_type, is_label = F.col("p") == RDF_TYPE, F.col("p") == RDFS + "label"
    stated = triples.select(
        F.col("s").alias("id"), F.lit(False).alias("literal"), F.lit(None).cast("string").alias("value"),
        F.when(is_type, F.col("o")).alias("class_uri"), F.when(is_label, F.col("o")).alias("label"),
    )
    none = F.lit(None).cast("string")
    objects = triples.where(~is_type & ~is_label).select(
        F.when(F.col("o_is_literal"), F.concat_ws("::", "s", "p", "o")).otherwise(F.col("o")).alias("id"),
        F.col("o_is_literal").alias("literal"), F.when(F.col("o_is_literal"), F.col("o")).alias("value"),
        none.alias("class_uri"), none.alias("label"),
    )
    nodes = stated.unionAll(objects).groupBy("id").agg(
        F.max("literal").alias("literal"), F.max("value").alias("value"), F.max("class_uri").alias("class_uri"), F.max("label").alias("label")
    )
    return nodes.withColumn("display", F.coalesce("label", "value", tx.local_name(F.col("id"))))


def graph_links(triples: DataFrame) -> DataFrame:
    """``(source, target, predicate)`` without type and label statements."""
    plain = triples.where((F.col("p") != RDF_TYPE) & (F.col("p") != RDFS + "label"))
    target = F.when(F.col("o_is_literal"), F.concat_ws("::", "s", "p", "o")).otherwise(F.col("o"))
    return plain.select(F.col("s").alias("source"), target.alias("target"), F.col("p").alias("predicate")).distinct()


def graph_to_triples(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The triples a node and a link table stand for."""
    things = nodes.where("NOT literal")
    types = things.where("class_uri IS NOT NULL").select(
        F.col("id").alias("s"), F.lit(RDF_TYPE).alias("p"), F.col("class_uri").alias("o"), F.lit(False).alias("o_is_literal")
    )
    labels = things.where("label IS NOT NULL").select(
        F.col("id").alias("s"), F.lit(RDFS + "label").alias("p"), F.col("label").alias("o"), F.lit(True).alias("o_is_literal")
    )
    target = nodes.select(F.col("id").alias("target"), "literal", "value")
    facts = links.join(target, "target").select(
        F.col("source").alias("s"), F.col("predicate").alias("p"),
        F.when(F.col("literal"), F.col("value")).otherwise(F.col("target")).alias("o"), F.col("literal").alias("o_is_literal"),
    )
    return types.unionByName(labels).unionByName(facts)


def suggest(nodes: DataFrame, query: str) -> DataFrame:
    """``(suggestion)``: IRIs in angle brackets and literal values that contain the text."""
    text = F.when(F.col("literal"), F.col("value")).otherwise(F.concat(F.lit("<"), "id", F.lit(">")))
    return nodes.select(text.alias("suggestion")).where(F.contains(F.lower("suggestion"), F.lit(query.lower()))).distinct()
