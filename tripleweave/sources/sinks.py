"""Writing matches, links and alignments, and the common exchange schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCHANGE = {
    "subject": "string", "predicate": "string", "object": "string", "start": "bigint", "length": "bigint",
    "score": "double", "source": "string",
}


def match_document(matches: DataFrame, id_type: str = "entity") -> DataFrame:
    """``(id_1, id_2, score, id_type)`` with string ids."""
    kind = F.col("id_type") if "id_type" in matches.columns else F.lit(id_type)
    return matches.select(
        F.col("id_1").cast("string").alias("id_1"), F.col("id_2").cast("string").alias("id_2"),
        F.col("score").cast("double").alias("score"), kind.alias("id_type"),
    )


def write_match_json(matches: DataFrame, path: str, envelope: bool = False) -> None:
    """One match per line, or one ``{matches, blocks, clusters}`` object for a small result."""
    doc = match_document(matches)
    if envelope:
        doc = doc.agg(F.array_sort(F.collect_list(F.struct("id_1", "id_2", "score", "id_type"))).alias("matches")).select(
            "matches", F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("clusters")
        )
    doc.write.json(path)


def clustered_records(left: DataFrame, right: DataFrame, links: DataFrame, id_left: str, id_right: str) -> DataFrame:
    """Rows of both tables with ``Cluster ID``, ``Link Score`` and ``source file`` (0 or 1)."""
    facts = [F.col("cluster_id").alias("Cluster ID"), F.col("score").alias("Link Score")]
    one = left.join(links.select(F.col("id_1").alias(id_left), *facts), id_left, "left")
    two = right.join(links.select(F.col("id_2").alias(id_right), *facts), id_right, "left")
    return one.withColumn("source file", F.lit(0)).unionByName(
        two.withColumn("source file", F.lit(1)), allowMissingColumns=True
    )


def write_clustered_csv(left: DataFrame, right: DataFrame, links: DataFrame, id_left: str, id_right: str, path: str) -> None:
    clustered_records(left, right, links, id_left, id_right).write.option("header", True).csv(path)


def alignment_lines(predicates: DataFrame, sameas: DataFrame) -> DataFrame:
    """``(line)``: predicates ``(p1, p2, score)`` above 0.1 and entities ``(e1, e2, score)`` above 0."""
    # The two relations, the score mark and the score limits of the output.
    statement = lambda a, rel, b: F.concat(a, F.lit(f" {rel} "), b, F.lit(" .# "), F.col("score").cast("string"))
    subs = predicates.where(F.col("score") > 0.1).select(statement("p1", "rdfs:subPropertyOf", "p2").alias("line"))
    same = sameas.where(F.col("score") > 0).select(statement("e1", "owl:sameAs", "e2").alias("line"))
    return subs.unionByName(same)


def write_alignment(predicates: DataFrame, sameas: DataFrame, path: str) -> None:
    alignment_lines(predicates, sameas).write.text(path)


def write_links_tsv(links: DataFrame, path: str) -> None:
    """``<s> TAB <t> TAB score`` without a header."""
    ref = lambda c: F.concat(F.lit("<"), F.col(c).cast("string"), F.lit(">")).alias(c)
    links.select(ref("id_1"), ref("id_2"), "score").write.option("sep", "\t").option("quote", "").csv(path)


def to_exchange(df: DataFrame, kind: str, source: str) -> DataFrame:
    """Matches, mentions or triples in one schema."""
    columns = {
        "matches": {"subject": "id_1", "object": "id_2", "score": "score"},
        "mentions": {"subject": "doc_id", "object": "entity", "start": "start", "length": "length", "score": "score"},
        "triples": {"subject": "s", "predicate": "p", "object": "o"},
    }[kind]
    fixed = {"predicate": {"matches": "owl:sameAs", "mentions": "mentions"}.get(kind), "source": source}
    return df.select(
        *[
            (F.col(columns[name]) if name in columns else F.lit(fixed.get(name))).cast(dtype).alias(name)
            for name, dtype in EXCHANGE.items()
        ]
    )
