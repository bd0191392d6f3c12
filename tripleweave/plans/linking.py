"""Entity and relation linking of short texts: the rules in their fixed order, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.functions import text as tx
from tripleweave.operators import linking as lk
from tripleweave.operators import mentions as mn
from tripleweave.plans.rounds import cut

# The default rule numbers.
RULES = (1, 2, 3, 4, 5, 8, 9, 10, 12, 13, 14)


def link_texts(
    texts: DataFrame,
    entities: DataFrame,
    properties: DataFrame,
    facts: DataFrame,
    stop_words: list[str],
    verbs: DataFrame,
    persons: DataFrame | None = None,
    rules: tuple[int, ...] = RULES,
    k: int = 1,
    search: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mention, label, uri, …)`` for entities and for relations.

    ``entities`` and ``properties`` are label tables ``(uri, label, numeric_id)``, ``facts`` is
    ``(s, p, o)``. The chunk and phrase tables are written once before the searches read them.
    """
    questions = texts.select("doc_id", tx.normalise_question(F.col("text")).alias("text"))
    labels = properties.select("label")
    tokens = cut(mn.annotate_tokens(questions, stop_words if 1 in rules else ["\u0001"], verbs), "tokens")
    # Without rule 2 every word is its own chunk, as in a text without stop words.
    chunks = mn.chunk_compounds(tokens if 2 in rules else tokens.withColumn("is_stop", F.lit(False)))
    phrases = []
    if 4 in rules:
        chunks, found = mn.split_on_verbs(chunks)
        phrases.append(found)
        chunks = mn.split_possessive(chunks)
    if 3 in rules:
        chunks, found = mn.merge_over_stopwords(cut(chunks, "chunks"), tokens, labels)
        phrases.append(found)
    if 5 in rules:
        chunks = mn.mark_entities(chunks, labels).drop("is_entity")
    if 8 in rules:
        chunks = mn.split_on_comparison(chunks)
    if 9 in rules:
        chunks = mn.extract_abbreviations(chunks)
    if 10 in rules and persons is not None:
        chunks, found = mn.split_on_person(chunks, persons)
        phrases.append(found)
    if 14 in rules:
        chunks, found = mn.extract_relations(cut(chunks, "chunks"), labels)
        phrases.append(found)
    chunks = mn.case_chunks(chunks)
    if 12 in rules:
        chunks = mn.merge_determiner(chunks, tokens)

    chunks = cut(chunks.select("doc_id", F.col("chunk").alias("mention")).distinct(), "mentions")
    entity_hits = lk.search_candidates(chunks, entities, search)
    found_entities = lk.ranked(chunks.join(entity_hits, "mention"))
    all_phrases = phrases[0] if phrases else chunks.limit(0).select("doc_id", F.lit(0).alias("start"), F.col("mention").alias("phrase"))
    for p in phrases[1:]:
        all_phrases = all_phrases.unionByName(p)
    all_phrases = cut(all_phrases.select("doc_id", F.col("phrase").alias("mention")).distinct(), "phrases")
    relation_hits = lk.search_candidates(all_phrases, properties, search)
    found_relations = lk.distinct_relations(lk.ranked(all_phrases.join(relation_hits, "mention")))
    found_relations = cut(found_relations.unionByName(lk.default_relation(texts, all_phrases)), "relations")

    heads = texts.select("doc_id", F.lower(F.substring_index(F.trim("text"), " ", 1)).alias("head"))
    found_entities, found_relations = lk.rerank_by_triples(cut(found_entities, "entities"), found_relations, facts, heads, 13 in rules)
    return lk.top_entities(found_entities, k), lk.top_relations(found_relations, k)
