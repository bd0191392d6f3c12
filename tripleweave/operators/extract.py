"""Triples out of text: model output, sentences, open and typed relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import text as tx
from tripleweave.operators.mentions import annotate_tokens

# The marks of the linearised form, and the padding marks it may carry.
TRIPLET, SUBJ, OBJ = "<triplet>", "<subj>", "<obj>"
PADDING = ("<s>", "<pad>", "</s>")

SENTENCE = r"[^.!?]+[.!?]*"


def parse_linearised_triples(df: DataFrame, col: str = "generated") -> DataFrame:
    """One row ``(…, head, type, tail)`` per triple of the linearised model output.

    The marks drive a small state machine, written as one fold over the words of a row.
    """
    text = F.col(col)
    for mark in PADDING:
        text = F.replace(text, F.lit(mark), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    found = "array<struct<head:string,type:string,tail:string>>"

    def state(mode, subj, obj, rel, out) -> Column:
        return F.struct(mode.alias("mode"), subj.alias("subj"), obj.alias("obj"), rel.alias("rel"), out.alias("out"))

    def emitted(s: Column) -> Column:
        row = F.struct(F.trim(s["subj"]).alias("head"), F.trim(s["rel"]).alias("type"), F.trim(s["obj"]).alias("tail"))
        return F.concat(s["out"], F.array(row))

    def pending(s: Column) -> Column:
        return F.when(s["rel"] != "", emitted(s)).otherwise(s["out"])

    blank = F.lit("")
    add = lambda part, w: F.concat(part, F.lit(" "), w)

    def step(s: Column, w: Column) -> Column:
        return (
            F.when(w == TRIPLET, state(F.lit("t"), blank, s["obj"], blank, pending(s)))
            .when(w == SUBJ, state(F.lit("s"), s["subj"], blank, s["rel"], pending(s)))
            .when(w == OBJ, state(F.lit("o"), s["subj"], s["obj"], blank, s["out"]))
            .when(s["mode"] == "t", state(s["mode"], add(s["subj"], w), s["obj"], s["rel"], s["out"]))
            .when(s["mode"] == "s", state(s["mode"], s["subj"], add(s["obj"], w), s["rel"], s["out"]))
            .when(s["mode"] == "o", state(s["mode"], s["subj"], s["obj"], add(s["rel"], w), s["out"]))
            .otherwise(s)
        )

    complete = lambda s: (s["subj"] != "") & (s["rel"] != "") & (s["obj"] != "")
    triples = F.aggregate(
        words, state(F.lit("x"), blank, blank, blank, F.array().cast(found)), step,
        lambda s: F.when(complete(s), emitted(s)).otherwise(s["out"]),
    )
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(triples).alias("_t")).select(*rest, "_t.*")


def sentences(texts: DataFrame) -> DataFrame:
    """``(doc_id, sentence_no, sentence)``."""
    parts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    return texts.select("doc_id", F.posexplode(parts).alias("sentence_no", "sentence"))


def tokens(sents: DataFrame) -> DataFrame:
    """``(doc_id, sentence_no, token_no, token)``."""
    return sents.select("doc_id", "sentence_no", F.posexplode(tx.words(F.col("sentence"))).alias("token_no", "token"))


def open_triples(texts: DataFrame, stop_words: list[str], verbs: DataFrame) -> DataFrame:
    """``(doc_id, sentence_no, subject, relation, object, confidence)`` per verb run.

    Subject and object are the word runs beside a run of verbs in a sentence. The confidence
    is the share of the words from subject to object that belong to the triple.
    """
    sents = sentences(texts)
    keyed = sents.select(
        F.struct("doc_id", "sentence_no").alias("doc_id"), F.regexp_replace("sentence", r"[.!?,;:]", "").alias("text")
    )
    toks = annotate_tokens(keyed, stop_words, verbs)
    sentence = Window.partitionBy("doc_id").orderBy("pos")
    kind = F.when(F.col("is_verb"), "v").when(F.col("is_stop"), "x").otherwise("n")
    runs = toks.withColumn("kind", kind)
    runs = runs.withColumn("_new", (F.col("kind") != F.lag("kind", 1, "").over(sentence)).cast("int"))
    runs = runs.withColumn("run", F.sum("_new").over(sentence.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'x'")
    spans = runs.groupBy("doc_id", "run", "kind").agg(
        F.min("pos").alias("a"), F.max("pos").alias("b"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_w")
    ).withColumn("phrase", F.array_join(F.transform("_w", lambda w: w["token"]), " "))
    order = Window.partitionBy("doc_id").orderBy("run")
    around = spans.select(
        "doc_id", "kind", "phrase", "a", "b",
        *[F.lag(c).over(order).alias(f"prev_{c}") for c in ("kind", "phrase", "a", "b")],
        *[F.lead(c).over(order).alias(f"next_{c}") for c in ("kind", "phrase", "a", "b")],
    ).where("kind = 'v' AND prev_kind = 'n' AND next_kind = 'n'")
    used = (F.col("b") - F.col("a") + 1) + (F.col("prev_b") - F.col("prev_a") + 1) + (F.col("next_b") - F.col("next_a") + 1)
    return around.select(
        "doc_id.doc_id", "doc_id.sentence_no", F.col("prev_phrase").alias("subject"), F.col("phrase").alias("relation"),
        F.col("next_phrase").alias("object"), (used / (F.col("next_b") - F.col("prev_a") + 1)).alias("confidence"),
    )


def typed_relations(triples: DataFrame, types: DataFrame, patterns: DataFrame) -> DataFrame:
    """Open triples mapped to fixed relations by subject type, object type and verb.

    ``types`` is ``(term, type)``, ``patterns`` is ``(verb, subject_type, object_type, relation)``.
    """
    subject = types.select(F.col("term").alias("subject"), F.col("type").alias("subject_type"))
    obj = types.select(F.col("term").alias("object"), F.col("type").alias("object_type"))
    named = triples.withColumnRenamed("relation", "verb")
    return named.join(subject, "subject").join(obj, "object").join(patterns, ["verb", "subject_type", "object_type"]).select(
        "doc_id", "subject", "relation", "object", "confidence"
    )
