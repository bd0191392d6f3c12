"""Candidates for mentions and relation phrases, ranking, and dictionary-based annotation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tripleweave.functions import text as tx
from tripleweave.plans.rounds import cut

# The relation a "when" question falls back to, and its boost.
WHEN_RELATION = ("time", "<http://www.wikidata.org/wiki/Property:P569>", 569, 0.0, 20)

CANDIDATE = ["label", "uri", "numeric_id", "score", "boost"]


def search_candidates(mentions: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """``(mention, label, uri, numeric_id, score, boost)``: the k most similar labels.

    Mentions are searched once each, however many texts hold them; "and"/"or" mentions also
    by their parts. ``labels`` is ``(uri, label, numeric_id)``; a candidate shares a word.
    """
    each = mentions.select("mention").distinct()
    pieces = F.array_distinct(F.concat(
        F.array("mention"),
        F.when(F.contains("mention", F.lit(" and ")), F.split("mention", " and ")).otherwise(F.array().cast("array<string>")),
        F.when(F.contains("mention", F.lit(" or ")), F.split("mention", " or ")).otherwise(F.array().cast("array<string>")),
    ))
    parts = each.select("mention", F.explode(pieces).alias("part")).withColumn("part", F.trim("part"))
    keyed = parts.select("part").distinct().select("part", F.explode(tx.tokens(F.col("part"))).alias("_w"))
    index = labels.select("uri", "label", "numeric_id", F.explode(tx.tokens(F.col("label"))).alias("_w"))
    found = keyed.join(index, "_w").select("part", "label", "uri", "numeric_id").distinct()
    score = F.round(tx.edit_similarity(F.lower("part"), F.lower("label")), 9)
    scored = found.withColumn("score", score)
    order = Window.partitionBy("part").orderBy(F.desc("score"), "numeric_id", "uri", "label")
    top = scored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")
    # Of several hits with one uri the best counts.
    best = parts.join(top, "part").groupBy("mention", "uri").agg(F.min(F.struct((-F.col("score")).alias("_s"), "label", "numeric_id", "score")).alias("_b"))
    return best.select("mention", "_b.label", "uri", "_b.numeric_id", "_b.score", F.lit(0).alias("boost"))


def distinct_relations(candidates: DataFrame) -> DataFrame:
    """First candidate per (text, mention, uri); ``rank`` gives the order."""
    rest = [c for c in candidates.columns if c not in ("doc_id", "mention", "uri", "rank")]
    first = candidates.groupBy("doc_id", "mention", "uri").agg(F.min(F.struct("rank", *rest)).alias("_b"))
    return first.select("doc_id", "mention", "uri", "_b.*")


def ranked(candidates: DataFrame) -> DataFrame:
    """Search order of the candidates of a mention."""
    order = Window.partitionBy("doc_id", "mention").orderBy(F.desc("score"), "numeric_id", "uri")
    return candidates.withColumn("rank", F.row_number().over(order))


def default_relation(texts: DataFrame, relations: DataFrame) -> DataFrame:
    """The fallback relation for texts that start with "when" and have no relation phrase."""
    label, uri, number, score, boost = WHEN_RELATION
    head = F.lower(F.substring_index(F.trim("text"), " ", 1))
    open_ = texts.where(head == "when").join(relations.select("doc_id").distinct(), "doc_id", "left_anti")
    return open_.select(
        "doc_id", F.lit("when").alias("mention"), F.lit(label).alias("label"), F.lit(uri).alias("uri"),
        F.lit(number).cast("bigint").alias("numeric_id"), F.lit(score).alias("score"), F.lit(boost).alias("boost"), F.lit(1).alias("rank"),
    )


def rerank_by_triples(entities: DataFrame, relations: DataFrame, facts: DataFrame, heads: DataFrame, head_rule: bool = True) -> tuple[DataFrame, DataFrame]:
    """Boost candidates that occur together in a fact.

    Per entity mention and relation mention the pairs are taken in rank order up to the first
    pair with a fact (entity, relation, ?); pairs before it count if (?, relation, entity)
    exists. The candidates of a text meet each other, then the distinct (node, predicate) pairs of the facts.
    ``heads`` is ``(doc_id, head)``. Returns entities and relations with new boosts.
    """
    # Boosts by direction, head word "who" and use of the head rule.
    forward = F.when(F.lit(not head_rule), 12).when(F.col("head") == "who", 45).otherwise(40)
    backward = F.when(F.lit(not head_rule), 13).when(F.col("head") == "who", 15).otherwise(12)

    # Which way a node and a predicate stand in a fact, one row each.
    sides = facts.select(F.col("s").alias("eu"), F.col("p").alias("ru"), F.lit(True).alias("_f")).unionAll(
        facts.select(F.col("o").alias("eu"), F.col("p").alias("ru"), F.lit(False).alias("_f"))
    )
    sides = cut(sides.groupBy("eu", "ru").agg(F.max("_f").alias("_fwd"), F.max(~F.col("_f")).alias("_bwd")), "sides")
    e = entities.select("doc_id", F.col("mention").alias("em"), F.col("uri").alias("eu"), F.col("rank").alias("er"))
    r = relations.select("doc_id", F.col("mention").alias("rm"), F.col("uri").alias("ru"), F.col("rank").alias("rr"))
    r = r.join(sides.select("ru").distinct(), "ru", "left_semi")
    # A text's own pairs ask for their fact: an entity is not spread over all predicates it is known with.
    hits = cut(e.join(r, "doc_id").join(sides, ["eu", "ru"]), "hits")
    place = F.struct("er", "rr")
    first = hits.where("_fwd").groupBy("doc_id", "em", "rm").agg(F.min(place).alias("_first"))
    # Mentions without a name have no first pair.
    met = hits.join(first, ["doc_id", "em", "rm"], "left")
    ahead, behind = F.col("_fwd") & (place == F.col("_first")), F.col("_bwd") & (F.col("_first").isNull() | (place < F.col("_first")))
    taken = met.where(ahead | behind).select("doc_id", "em", "eu", "rm", "ru", F.coalesce(ahead, F.lit(False)).alias("ahead"))
    gains = taken.join(heads, "doc_id", "left").withColumn("gain", F.when(F.col("ahead"), forward).otherwise(backward))

    def boosted(df: DataFrame, mention: str, uri: str) -> DataFrame:
        sums = gains.groupBy("doc_id", F.col(mention).alias("mention"), F.col(uri).alias("uri")).agg(F.sum("gain").alias("_g"))
        return df.join(sums, ["doc_id", "mention", "uri"], "left").withColumn("boost", F.col("boost") + F.coalesce("_g", F.lit(0))).drop("_g")

    return boosted(entities, "em", "eu"), boosted(relations, "rm", "ru")


def top_entities(candidates: DataFrame, k: int = 1) -> DataFrame:
    """Per mention the k best by boost, score, smaller id."""
    order = Window.partitionBy("doc_id", "mention").orderBy(F.desc("boost"), F.desc("score"), "numeric_id", "uri")
    return candidates.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def top_relations(candidates: DataFrame, k: int = 1) -> DataFrame:
    """Per mention the k best: boost, smaller id, score; without any boost score, smaller id."""
    mention = Window.partitionBy("doc_id", "mention")
    flagged = candidates.withColumn("_any", F.max("boost").over(mention) > 0)
    order = mention.orderBy(F.desc("boost"), F.when(F.col("_any"), F.col("numeric_id")), F.desc("score"), "numeric_id", "uri")
    return flagged.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn", "_any")


def evaluate_linking(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """``(doc_id, precision, recall, correct, wrong)`` per text of ``(doc_id, uri)`` tables."""
    p, g = pred.select("doc_id", "uri").distinct(), gold.select("doc_id", "uri").distinct()
    both = p.withColumn("_p", F.lit(1)).join(g.withColumn("_g", F.lit(1)), ["doc_id", "uri"], "full")
    counts = both.groupBy("doc_id").agg(
        F.count("_p").alias("n_pred"), F.count("_g").alias("n_gold"), F.count(F.when(F.col("_p") + F.col("_g") == 2, 1)).alias("correct")
    ).where("n_gold > 0")
    ratio = lambda n: F.when((F.col("n_pred") > 0) & (F.col("n_gold") > 0), F.col("correct") / F.col(n)).otherwise(F.lit(0.0))
    return counts.select(
        "doc_id", ratio("n_pred").alias("precision"), ratio("n_gold").alias("recall"), "correct", (F.col("n_gold") - F.col("correct")).alias("wrong")
    )


def linking_share(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """``(correct, wrong, share)``, one row: how many of all gold links of all texts were found. No gold links: share 0."""
    per_text = evaluate_linking(pred, gold)
    sums = per_text.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("correct", "wrong")])
    asked = F.col("correct") + F.col("wrong")
    return sums.withColumn("share", F.when(asked > 0, F.col("correct") / asked).otherwise(F.lit(0.0)))


# --- dictionary-based annotation -------------------------------------------------------


def commonness(anchors: DataFrame) -> DataFrame:
    """``(surface, entity, n, prior)``: share of a surface form's links that mean an entity."""
    pairs = anchors.groupBy("surface", "entity").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("surface").agg(F.sum("n").alias("_t"))
    return pairs.join(totals, "surface").select("surface", "entity", "n", (F.col("n") / F.col("_t")).alias("prior"))


def _tokens_with_offsets(texts: DataFrame) -> DataFrame:
    """``(doc_id, pos, token, start)``: blank-separated words with their character offsets."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    words = texts.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return words.withColumn("start", F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)).cast("int"))


@F.pandas_udf(ArrayType(IntegerType()))
def _without_overlap(pos: pd.Series, n: pd.Series) -> pd.Series:
    """Places of the hits to keep. Longest first, so a kept hit that overlaps another covers one of its ends."""

    def of_text(starts, sizes):
        taken, kept = set(), []
        for i, (a, k) in enumerate(zip(starts, sizes, strict=True)):
            if a not in taken and a + k - 1 not in taken:
                kept.append(i)
                taken.update(range(a, a + k))
        return kept

    return pd.Series([of_text(a, k) for a, k in zip(pos, n, strict=True)])


def spot_mentions(texts: DataFrame, surfaces: DataFrame, n: int | None = None) -> DataFrame:
    """``(doc_id, start, length, surface)``: word n-grams that are known surface forms.

    Of overlapping ones the longer, then the earlier stays. N-grams of a text are built from
    its own words by window offsets, up to the words of the longest surface form unless ``n`` is
    given; the dictionary is met by an equi-join. Work grows with the words of a text; ``doc_id`` names one text.
    """
    n = n or surfaces.agg(F.max(F.size(F.split("surface", " ")))).first()[0] or 1
    toks = _tokens_with_offsets(texts)
    here = Window.partitionBy("doc_id").orderBy("pos")
    grams = None
    words, ends = F.col("token"), F.col("start") + F.length("token")
    for size in range(1, n + 1):
        if size > 1:
            nxt = F.lead("token", size - 1).over(here)
            words = F.concat(words, F.lit(" "), nxt)
            ends = F.lead("start", size - 1).over(here) + F.length(nxt)
        part = F.struct(words.alias("surface"), (ends - F.col("start")).alias("length"), F.lit(size).alias("n"))
        grams = [part] if grams is None else [*grams, part]
    rows = toks.select("doc_id", "pos", "start", F.array(*grams).alias("g")).select("doc_id", "pos", "start", F.explode("g").alias("g")).select(
        "doc_id", "pos", "start", "g.*"
    ).where("surface IS NOT NULL AND surface <> ''")
    hits = rows.join(surfaces.select("surface").distinct(), "surface", "left_semi")
    order = F.struct((-F.col("n")).alias("k"), "pos", "n", "start", "length", "surface")
    listed = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("h"))
    # Longest first; a hit stays if no kept one overlaps it. The list is that of one text.
    kept = F.transform(_without_overlap(F.col("h.pos"), F.col("h.n")), lambda i: F.get("h", i))
    return listed.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.start", "x.length", "x.surface")


def _context(df: DataFrame, key: list[str], text: str) -> DataFrame:
    return df.select(*key, F.explode(tx.words(F.col(text))).alias("w")).groupBy(*key, "w").agg(F.count("*").cast("double").alias("tf"))


def disambiguate(mentions: DataFrame, priors: DataFrame, texts: DataFrame, entity_texts: DataFrame, prior_weight: float = 0.5) -> DataFrame:
    """Best entity per mention: prior blended with the tf-idf cosine of text and entity text.

    Texts and entities are compared once per (text, entity), through their common words. An entity may have many texts; together
    they are its context.
    """
    candidates = mentions.join(priors.select("surface", "entity", "prior"), "surface")
    pairs = candidates.select("doc_id", "entity").distinct()
    doc_tf, ent_tf = _context(texts, ["doc_id"], "text"), _context(entity_texts, ["entity"], "text")
    total = entity_texts.agg(F.count_distinct("entity").cast("double").alias("n")).scalar()
    idf = ent_tf.groupBy("w").agg(F.count("*").alias("df")).select("w", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weigh = lambda tf, key: tf.join(idf, "w").select(key, "w", (F.col("tf") * F.col("idf")).alias("x"))
    d, e = weigh(doc_tf, "doc_id"), weigh(ent_tf, "entity")
    norm = lambda v, key: v.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    # A text has few words, an entity may have those of all its texts: a pair takes the words of its text along.
    known = pairs.join(e.select("entity").distinct(), "entity", "left_semi")
    dots = known.join(d.withColumnRenamed("x", "xd"), "doc_id").join(e.withColumnRenamed("x", "xe"), ["entity", "w"]).groupBy("doc_id", "entity").agg(
        F.sum(F.col("xe") * F.col("xd")).alias("dot")
    )
    cosine = (
        dots.join(norm(d, "doc_id").withColumnRenamed("norm", "nd"), "doc_id").join(norm(e, "entity").withColumnRenamed("norm", "ne"), "entity")
        .select("doc_id", "entity", (F.col("dot") / (F.col("nd") * F.col("ne"))).alias("cosine"))
    )
    score = prior_weight * F.col("prior") + (1 - prior_weight) * F.coalesce("cosine", F.lit(0.0))
    scored = candidates.join(cosine, ["doc_id", "entity"], "left").withColumn("score", score)
    best = scored.groupBy("doc_id", "start", "length", "surface").agg(F.min(F.struct((-F.round("score", 9)).alias("_s"), "entity", "score")).alias("_b"))
    return best.select("doc_id", "start", "length", "surface", "_b.entity", "_b.score")


def annotate(texts: DataFrame, anchors: DataFrame, entity_texts: DataFrame, confidence: float = 0.5, spans: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Annotations with offsets: spotted (or given) mentions, linked, above the confidence."""
    priors = commonness(anchors)
    mentions = spot_mentions(texts, priors, n) if spans is None else spans
    return disambiguate(mentions, priors, texts, entity_texts).where(F.col("score") >= confidence)

