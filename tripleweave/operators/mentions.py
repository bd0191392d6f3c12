"""Surface forms in short texts: token flags, chunks, and the rules that cut and join them.

A chunk is ``(doc_id, chunk_no, start, end, chunk, words)``; ``words`` holds the chunk's
tokens with their flags. Windows are per text, so they are as long as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import text as tx

# Word lists of the rules.
DETERMINERS = ["the", "a", "an", "this", "that", "these", "those", "some", "any", "each", "every", "all", "both", "no"]
COMPARISON_WORDS = [
    "more", "less", "greater", "smaller", "bigger", "larger", "higher", "lower", "older", "younger", "longer", "shorter",
    "taller", "deeper", "earlier", "later", "faster", "slower", "most", "least",
]

FLAGS = ["pos", "token", "lower", "is_stop", "is_verb", "is_upper", "is_det"]
CHUNK = ["doc_id", "chunk_no", "start", "end", "chunk", "words"]


def annotate_tokens(texts: DataFrame, stop_words: list[str], verbs: DataFrame | None = None, determiners: list[str] = DETERMINERS) -> DataFrame:
    """``(doc_id, pos, token, lower, is_stop, is_verb, is_upper, is_det)``.

    "name" is never a stop word; ``verbs`` is a one-column word table. The lexicon side is
    left to the planner, which broadcasts it when its size allows.
    """
    parts = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    rows = texts.select("doc_id", F.posexplode(parts).alias("pos", "token"))
    low = F.lower("token")
    flagged = rows.select(
        "doc_id", "pos", "token", low.alias("lower"),
        (low.isin(*stop_words) & (low != "name")).alias("is_stop"),
        ((F.col("token") == F.upper("token")) & (F.col("token") != low)).alias("is_upper"),
        low.isin(*determiners).alias("is_det"),
    )
    if verbs is None:
        return flagged.withColumn("is_verb", F.lit(False)).select("doc_id", *FLAGS)
    known = verbs.toDF("lower").distinct().withColumn("_v", F.lit(True))
    return flagged.join(known, "lower", "left").select(
        "*", (F.coalesce("_v", F.lit(False)) & ~F.col("is_stop")).alias("is_verb")
    ).select("doc_id", *FLAGS)


def _gather(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks from token rows of the same key, numbered by position within the text."""
    grouped = rows.groupBy("doc_id", *keys).agg(F.array_sort(F.collect_list(F.struct(*FLAGS))).alias("words"))
    by_place = Window.partitionBy("doc_id").orderBy("start", "_w")
    return (
        grouped.select(
            "doc_id", F.col("words")[0]["pos"].alias("start"), F.element_at("words", -1)["pos"].alias("end"),
            F.array_join(F.transform("words", lambda w: w["token"]), " ").alias("chunk"), "words", *[F.col(k).alias(f"_{k}") for k in keys],
        )
        .withColumn("_w", F.col("end"))
        .withColumn("chunk_no", F.row_number().over(by_place))
        .select(*CHUNK)
    )


def chunk_compounds(tokens: DataFrame) -> DataFrame:
    """Longest runs without stop words; a text without stop words gives single words."""
    text = Window.partitionBy("doc_id")
    running = text.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        tokens.withColumn("_any", F.max("is_stop").over(text))
        .withColumn("island", F.when(F.col("_any"), F.sum(F.col("is_stop").cast("int")).over(running)).otherwise(F.col("pos")))
        .where("NOT is_stop")
    )
    return _gather(runs, ["island"])


def _words(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", F.explode("words").alias("w")).select("doc_id", "chunk_no", "w.*")


def _split(chunks: DataFrame, breaks: Column, alone: Column | None = None) -> DataFrame:
    """Cut chunks at the words where ``breaks`` holds, dropping them; ``alone`` words stand alone."""
    rows = _words(chunks).withColumn("_b", breaks).withColumn("_a", F.lit(False) if alone is None else alone)
    running = Window.partitionBy("doc_id", "chunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cutting = (F.col("_b") | F.col("_a")).cast("int")
    after = F.lag(F.col("_a").cast("int"), 1, 0).over(Window.partitionBy("doc_id", "chunk_no").orderBy("pos"))
    rows = rows.withColumn("_x", cutting + after).withColumn("island", F.sum("_x").over(running)).where("NOT _b")
    return _gather(rows, ["chunk_no", "island"])


def split_on_verbs(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks cut at verbs, and the verbs as relation phrases ``(doc_id, start, phrase)``."""
    verbs = _words(chunks).where("is_verb").select("doc_id", F.col("pos").alias("start"), F.col("token").alias("phrase"))
    return _split(chunks, F.col("is_verb")), verbs


def split_possessive(chunks: DataFrame) -> DataFrame:
    """Chunks cut at ``'s``, or at ``'`` where a chunk has no ``'s``."""
    mark = F.when(F.contains("chunk", F.lit("'s")), F.lit("'s")).otherwise(F.lit("'"))
    rows = chunks.select("doc_id", "chunk_no", mark.alias("_m"), F.explode("words").alias("w")).select("doc_id", "chunk_no", "_m", "w.*")
    parts = F.split(F.col("token"), F.col("_m"))
    subs = rows.select("*", F.posexplode(parts).alias("_i", "_sub"))
    running = Window.partitionBy("doc_id", "chunk_no").orderBy("pos", "_i").rowsBetween(Window.unboundedPreceding, 0)
    islands = subs.withColumn("island", F.sum(F.when(F.col("_i") > 0, 1).otherwise(0)).over(running)).where("_sub <> ''")
    cut_rows = islands.withColumn("token", F.col("_sub")).withColumn("lower", F.lower("_sub"))
    return _gather(cut_rows, ["chunk_no", "island"])


def split_on_comparison(chunks: DataFrame, comparison_words: list[str] = COMPARISON_WORDS) -> DataFrame:
    """Chunks cut at comparison words; "than" goes with them."""
    has = F.exists("words", lambda w: w["lower"].isin(*comparison_words))
    cut_here = _split(chunks.where(has), F.col("lower").isin("than", *comparison_words))
    return renumber(chunks.where(~has).unionByName(cut_here))


def extract_abbreviations(chunks: DataFrame) -> DataFrame:
    """All-upper words become chunks of their own."""
    return _split(chunks, F.lit(False), F.col("is_upper"))


def renumber(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("start", "end", "chunk")
    return chunks.withColumn("chunk_no", F.row_number().over(order)).select(*CHUNK)


def _norm(col: Column | str) -> Column:
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def most_words(table: DataFrame, col: str) -> int:
    """Words of the longest entry of a dictionary, 1 at least."""
    return table.agg(F.max(F.size(F.split(F.col(col), r"\s+")))).first()[0] or 1


def merge_over_stopwords(chunks: DataFrame, tokens: DataFrame, property_labels: DataFrame, max_gap: int = 2) -> tuple[DataFrame, DataFrame]:
    """Neighbours with at most two plain stop words between become one chunk.

    Not across "is" or a verb, and across "and" only between single words. A chunk that is a
    property label leaves as a relation phrase; so does the chunk merged with its neighbour if
    that is a label. The scan over the chunks of a text is one fold over their array; the
    labels met by any run of chunks are found beforehand by an equi-join. Runs are as long as the
    longest label.
    """
    labels = property_labels.toDF("_label").select(_norm("_label").alias("_label")).distinct()
    longest = most_words(labels, "_label")
    text = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "lower", "is_stop", "is_verb"))).alias("toks"))
    listed = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.size("words").alias("n")))).alias("cs")
    ).join(text, "doc_id")

    def words_between(a: Column, b: Column) -> Column:
        return F.slice("toks", a + 1, F.greatest(b - a + 1, F.lit(0)))

    gaps = F.transform("cs", lambda c, i: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"),
        words_between(c["end"] + 1, F.get("cs", i + 1)["start"] - 1).alias("gap"),
    ))
    plain = F.transform(gaps, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"),
        ((F.size(c["gap"]) <= max_gap) & ~F.exists(c["gap"], lambda w: ~w["is_stop"] | w["is_verb"] | (w["lower"] == "is"))).alias("ok"),
        F.exists(c["gap"], lambda w: w["lower"] == "and").alias("with_and"),
    ))
    listed = listed.withColumn("cs", plain)

    # Runs of neighbouring chunks short enough to be a label.
    runs = listed.select("doc_id", "toks", F.col("cs").alias("_cs"), F.posexplode("cs").alias("i", "c")).select(
        "doc_id", "toks", F.col("c.start").alias("start"),
        F.explode(F.filter(F.slice("_cs", F.col("i") + 1, longest), lambda d: d["end"] - F.col("c.start") < longest)).alias("d"),
    )
    run_text = F.array_join(F.transform(F.slice("toks", F.col("start") + 1, F.col("d.end") - F.col("start") + 1), lambda w: w["lower"]), " ")
    known = runs.select("doc_id", "start", F.col("d.end").alias("end"), run_text.alias("_label")).join(labels, "_label", "left_semi")
    known = known.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("props"))
    ready = listed.join(known, "doc_id", "left").withColumn(
        "props", F.coalesce("props", F.array().cast("array<struct<start:int,end:int>>"))
    )

    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    state = lambda a, b, n, ok, w, fresh, ents, rels: F.struct(
        a.alias("a"), b.alias("b"), n.alias("n"), ok.alias("ok"), w.alias("w"), fresh.alias("fresh"), ents.alias("ents"), rels.alias("rels")
    )
    zero = state(F.lit(-1), F.lit(-1), F.lit(0), F.lit(False), F.lit(False), F.lit(True), empty, empty)

    def step(s: Column, c: Column) -> Column:
        own = span(s["a"], s["b"])
        joined = span(s["a"], c["end"])
        ok = s["ok"] & (~s["w"] | ((s["n"] == 1) & (c["n"] == 1)))
        is_prop = F.array_contains("props", own)
        start_new = lambda ents, rels: state(c["start"], c["end"], c["n"], c["ok"], c["with_and"], F.lit(False), ents, rels)
        add = lambda arr, x: F.concat(arr, F.array(x))
        return (
            F.when(s["fresh"], start_new(s["ents"], s["rels"]))
            .when(is_prop & ok & F.array_contains("props", joined),
                  state(s["a"], c["end"], s["n"] + c["n"], F.lit(False), F.lit(False), F.lit(True), s["ents"], add(s["rels"], joined)))
            .when(is_prop, start_new(s["ents"], add(s["rels"], own)))
            .when(ok, state(s["a"], c["end"], c["end"] - s["a"] + 1, c["ok"], c["with_and"], F.lit(False), s["ents"], s["rels"]))
            .otherwise(start_new(add(s["ents"], own), s["rels"]))
        )

    folded = ready.withColumn(
        "_r", F.aggregate("cs", zero, step, lambda s: F.struct(F.concat(s["ents"], F.array(span(s["a"], s["b"]))).alias("ents"), s["rels"].alias("rels")))
    )

    def texts_of(field: str) -> DataFrame:
        rows = folded.select("doc_id", "toks", F.explode(f"_r.{field}").alias("x")).select("doc_id", "toks", "x.start", "x.end")
        return rows.select(
            "doc_id", "start", "end",
            F.array_join(F.transform(F.slice("toks", F.col("start") + 1, F.col("end") - F.col("start") + 1), lambda w: w["token"]), " ").alias("phrase"),
        )

    spans = texts_of("ents").select("doc_id", "start", "end")
    full = tokens.join(spans, "doc_id").where("pos BETWEEN start AND end").drop("end").withColumnRenamed("start", "island")
    return _gather(full, ["island"]), texts_of("rels").select("doc_id", "start", "phrase")


def mark_entities(chunks: DataFrame, property_labels: DataFrame) -> DataFrame:
    """Capitalise lower-case chunks that share no word with any property label."""
    words_of = property_labels.toDF("_label").select(F.explode(tx.tokens(F.col("_label"))).alias("_w")).distinct()
    keyed = chunks.select("doc_id", "chunk_no", F.explode(tx.tokens(F.col("chunk"))).alias("_w"))
    related = keyed.join(words_of, "_w", "left_semi").select("doc_id", "chunk_no").distinct().withColumn("_p", F.lit(True))
    first = F.substring("chunk", 1, 1)
    upper_first = (first == F.upper(first)) & (first != F.lower(first))
    marked = chunks.join(related, ["doc_id", "chunk_no"], "left").withColumn("is_entity", F.col("_p").isNull() & ~upper_first)
    return marked.withColumn("chunk", F.when(F.col("is_entity"), capitalise(F.col("chunk"))).otherwise(F.col("chunk"))).select(*CHUNK, "is_entity")


def capitalise(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def split_on_person(chunks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known persons, extended by neighbouring capitalised words, become chunks of their own.

    What is left of such a chunk is a chunk too and also a relation phrase. The longest,
    then leftmost name of a chunk counts.
    """
    known = names.toDF("_name").select(F.lower("_name").alias("_name")).distinct()
    word_list = F.transform("words", lambda w: w["token"])
    grams = chunks.select("doc_id", "chunk_no", word_list.alias("ws"), F.posexplode("words").alias("i", "_w")).select(
        "doc_id", "chunk_no", "i", "ws", F.explode(F.sequence(F.lit(1), F.lit(most_words(known, "_name")))).alias("n")
    ).where("i + n <= size(ws)")
    hits = grams.withColumn("_name", F.lower(F.array_join(F.slice("ws", F.col("i") + 1, F.col("n")), " "))).join(known, "_name", "left_semi")
    best = hits.groupBy("doc_id", "chunk_no").agg(F.min(F.struct((-F.col("n")).alias("k"), "i", "n")).alias("_b")).select(
        "doc_id", "chunk_no", F.col("_b.i").alias("i"), F.col("_b.n").alias("n")
    )
    first = lambda t: F.substring(t, 1, 1)
    proper = lambda w: (first(w["token"]) == F.upper(first(w["token"]))) & (first(w["token"]) != F.lower(first(w["token"])))
    flags = F.transform("words", proper)
    joined = chunks.join(best, ["doc_id", "chunk_no"], "left").withColumn("_f", flags)
    # Walk outwards from the name while the neighbour is capitalised.
    left = F.aggregate(F.reverse(F.slice("_f", 1, F.col("i"))), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")),
                       lambda s, x: F.struct((s["k"] + (s["go"] & x).cast("int")).alias("k"), (s["go"] & x).alias("go")), lambda s: s["k"])
    right = F.aggregate(F.slice("_f", F.col("i") + F.col("n") + 1, F.size("_f")), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")),
                        lambda s, x: F.struct((s["k"] + (s["go"] & x).cast("int")).alias("k"), (s["go"] & x).alias("go")), lambda s: s["k"])
    found = joined.where("i IS NOT NULL").withColumn("_lo", F.col("i") - left).withColumn("_hi", F.col("i") + F.col("n") - 1 + right)
    rows = found.select("doc_id", "chunk_no", "_lo", "_hi", F.posexplode("words").alias("_k", "w")).select("doc_id", "chunk_no", "_k", "_lo", "_hi", "w.*")
    side = F.when(F.col("_k") < F.col("_lo"), 0).when(F.col("_k") <= F.col("_hi"), 1).otherwise(2)
    pieces = rows.withColumn("island", side)
    rest = pieces.where("island <> 1").groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    relations = rest.select("doc_id", F.col("_t")[0]["pos"].alias("start"), F.array_join(F.transform("_t", lambda t: t["token"]), " ").alias("phrase"))
    untouched = joined.where("i IS NULL").select(*CHUNK)
    return renumber(untouched.unionByName(_gather(pieces, ["chunk_no", "island"]))), relations


def extract_relations(chunks: DataFrame, property_labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that equal a property label leave as relation phrases."""
    labels = property_labels.toDF("_label").select(_norm("_label").alias("_label")).distinct()
    keyed = chunks.withColumn("_label", _norm("chunk"))
    relations = keyed.join(labels, "_label", "left_semi").select("doc_id", "start", F.col("chunk").alias("phrase"))
    return keyed.join(labels, "_label", "left_anti").select(*CHUNK), relations


def case_chunks(chunks: DataFrame) -> DataFrame:
    """Relation-bearing chunks in lower case, others capitalised; each once, ignoring case."""
    bearing = F.exists("words", lambda w: w["is_verb"])
    cased = chunks.withColumn("chunk", F.when(bearing, F.lower("chunk")).otherwise(capitalise(F.col("chunk"))))
    first = cased.groupBy("doc_id", F.lower("chunk").alias("_l")).agg(
        F.min(F.struct("start", "chunk_no", "end", "chunk", "words")).alias("_c")
    )
    return first.select("doc_id", "_c.*").select(*CHUNK)


def merge_determiner(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """A determiner directly before a title-case chunk is put in front of it."""
    before = tokens.where("is_det").select("doc_id", (F.col("pos") + 1).alias("start"), F.col("token").alias("_d"))
    title = F.col("chunk") == F.array_join(F.transform(F.split("chunk", " "), capitalise), " ")
    letters = F.lower("chunk") != F.upper("chunk")
    joined = chunks.join(before, ["doc_id", "start"], "left")
    merged = F.when(F.col("_d").isNotNull() & title & letters, F.concat_ws(" ", capitalise(F.col("_d")), "chunk"))
    return joined.withColumn("chunk", F.coalesce(merged, F.col("chunk"))).select(*CHUNK)
