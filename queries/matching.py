"""Pair scoring, features, learning, resolution, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.blocking import (
    CC, JS, SL, TURNS, cc_blocks, passages_and_documents, sql_edges, sql_filtered, sql_raw, sql_weights, turn_blocks, turns, FORMULA,
)
from queries.common import Registry, r6, sql_qgrams, sql_tokens, sql_words, table
from tripleweave.functions import text as tx
from tripleweave.operators import blocking as bl
from tripleweave.operators import cluster as cl
from tripleweave.operators import learning as ln
from tripleweave.operators import matching as mt
from tripleweave.operators import meta
from tripleweave.operators import prepare as pr
from tripleweave.plans.resolve import auto_er as run_auto_er
from tripleweave.plans.resolve import resolve_entities as run_resolve
from tripleweave.plans.rounds import cut

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


def sql_vectors(texts: str, tokens: str, p: str = "v") -> str:
    """CTEs ``{p}`` (tf-idf vectors) and ``{p}s`` (token counts) over a text table."""
    return f"""
    {p}x as ({texts}),
    {p}f as (select side, id, token, count(*)::double tf from (select side, id, unnest({tokens}) token from {p}x) group by all),
    {p}d as (select token, count(*) df from {p}f group by 1),
    {p}r as (select side, id, token, tf * (ln((1 + (select count(*) from {p}x)) / (1.0::double + df)) + 1) w from {p}f join {p}d using (token)),
    {p}n as (select side, id, sqrt(sum(w * w)) norm from {p}r group by all),
    {p} as (select side, id, token, w / norm weight from {p}r join {p}n using (side, id)),
    {p}s as (select side, id, count(*)::double n from {p}f group by all)"""


GRAMS = sql_qgrams("lower(text)")


@reg.query("vectorise_tfidf", f"with {sql_vectors(TURNS, sql_words('text'))} select side, id, token, round(weight, 6) weight from v")
def vectorise_tfidf(spark, sf):
    return mt.vectorise(turns(spark, sf), "word", weighting="tfidf").withColumn("weight", r6("weight"))


PAIRS = f"{sql_weights('EJS', True)}, pairs as (select id_1, id_2 from w where weight >= (select avg(weight) from w) * {SL})"
SCORED = f"""{PAIRS}, {sql_vectors(CC, GRAMS)},
sc as (select p.id_1, p.id_2, sum(a.weight * b.weight) dot, count(*)::double s from pairs p
  join v a on a.side = 1 and a.id = p.id_1 join v b on b.side = 2 and b.id = p.id_2 and b.token = a.token group by all)"""


def sql_sets(formula: str, threshold: float) -> str:
    return f"""{SCORED} select id_1, id_2, round({formula}, 6) score from sc join vs a on a.side = 1 and a.id = id_1
    join vs b on b.side = 2 and b.id = id_2 where {formula} > {threshold}"""


def wep_pairs(spark, sf):
    return meta.weighted_edge_pruning(meta.edge_weights(cc_blocks(spark, sf), "EJS", clean_clean=True))


@reg.query("match_cosine", f"{SCORED} select id_1, id_2, round(dot, 6) score from sc where dot > 0.2")
def match_cosine(spark, sf):
    vectors = cut(mt.vectorise(passages_and_documents(spark, sf)), "vectors")
    return mt.match_pairs(wep_pairs(spark, sf), vectors, "cosine", 0.2).withColumn("score", r6("score"))


@reg.query("match_dice", sql_sets("2 * s / (a.n + b.n)", 0.2))
def match_dice(spark, sf):
    vectors = cut(mt.vectorise(passages_and_documents(spark, sf), weighting="boolean"), "vectors")
    return mt.match_pairs(wep_pairs(spark, sf), vectors, "dice", 0.2).withColumn("score", r6("score"))


@reg.query("match_jaccard", sql_sets("s / (a.n + b.n - s)", 0.1))
def match_jaccard(spark, sf):
    vectors = cut(mt.vectorise(passages_and_documents(spark, sf), weighting="boolean"), "vectors")
    return mt.match_pairs(wep_pairs(spark, sf), vectors, "jaccard", 0.1).withColumn("score", r6("score"))


@reg.query("match_semantic", """with e as (select vec_id, embedding::double[] v from embeddings),
s as (select a.vec_id id_1, b.vec_id id_2, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) score
 from e a join e b on b.vec_id = a.vec_id + 1) select id_1, id_2, round(score, 6) score from s where score > 0.05""")
def match_semantic(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    pairs = vecs.select(F.col("id").alias("id_1"), (F.col("id") + 1).alias("id_2"))
    return mt.match_semantic(pairs, vecs, vecs, "cosine", 0.05).withColumn("score", r6("score"))


@reg.query("best_per_source", """select l_partkey id_1, l_suppkey id_2, l_quantity / 50 score from lineitem
qualify row_number() over (partition by l_partkey order by l_quantity desc, l_suppkey) = 1""")
def best_per_source(spark, sf):
    line = table(spark, sf, "lineitem")
    return mt.best_per_source(line.select(F.col("l_partkey").alias("id_1"), F.col("l_suppkey").alias("id_2"), (F.col("l_quantity") / 50).alias("score")))


PART_REC = "select p_partkey, p_name title, concat_ws(' ', p_name, p_brand, p_type) descr, case when p_size > 45 then null else p_retailprice end price from part"


def part_records(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("descr"),
        F.when(F.col("p_size") <= 45, F.col("p_retailprice")).alias("price"),
    )


def next_parts(recs):
    pairs = recs.select(F.col("p_partkey").alias("id_1"), (F.col("p_partkey") + 1).alias("id_2"))
    return mt.with_records(pairs, recs, recs, "p_partkey", "p_partkey")


PAIRED = f"""with r as ({PART_REC}), p as (select a.p_partkey id_1, b.p_partkey id_2, a.title lt, b.title rt, a.descr ld, b.descr rd, a.price lp, b.price rp
 from r a join r b on b.p_partkey = a.p_partkey + 1)"""


@reg.query("field_comparators", f"""{PAIRED}, {sql_vectors("select 1 side, p_partkey id, descr as text from r", sql_words('text'))},
c as (select p.id_1, p.id_2, sum(a.weight * b.weight) cosine from p join v a on a.id = id_1 join v b on b.id = id_2 and a.token = b.token group by all)
select p.id_1, p.id_2, round(levenshtein(lt, rt) / greatest(length(lt), length(rt))::double, 6) title_distance, 0 title_missing,
 round(1 - coalesce(cosine, 0), 6) descr_distance, 0 descr_missing,
 round(coalesce(abs(ln(lp) - ln(rp)), 0), 6) price_distance, (lp is null or rp is null)::int price_missing
from p left join c using (id_1, id_2)""")
def field_comparators(spark, sf):
    recs = part_records(spark, sf)
    pairs = next_parts(recs)
    texts = bl.entity_texts(recs, "p_partkey", ["descr"])
    cosine = mt.score_pairs(pairs, mt.vectorise(texts, "word"), "cosine", clean_clean=False).withColumnRenamed("score", "cosine")
    joined = pairs.join(cosine, ["id_1", "id_2"], "left")
    out = mt.field_comparators(joined, ["title"], {"descr": F.coalesce("cosine", F.lit(0.0))}, ["price"])
    return out.select("id_1", "id_2", *[r6(c).alias(c) if c.endswith("distance") else F.col(c) for c in out.columns[2:]])


def sql_jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))))"


@reg.query("feature_vectors", f"""{PAIRED}, f as (select id_1, id_2, {sql_qgrams('lower(lt)')} ltg, {sql_qgrams('lower(rt)')} rtg, {sql_tokens('lt')} ltw, {sql_tokens('rt')} rtw,
 {sql_qgrams('lower(ld)')} ldg, {sql_qgrams('lower(rd)')} rdg, {sql_tokens('ld')} ldw, {sql_tokens('rd')} rdw, lt, rt, lp, rp from p)
select id_1, id_2, round({sql_jaccard('ltg', 'rtg')}, 6) title_jac_qgm_3, round({sql_jaccard('ltw', 'rtw')}, 6) title_jac_words,
 round(len(list_intersect(ltw, rtw)) / sqrt(len(ltw) * len(rtw)), 6) title_cos_words, round(1 - levenshtein(lt, rt) / greatest(length(lt), length(rt))::double, 6) title_edit,
 round({sql_jaccard('ldg', 'rdg')}, 6) descr_jac_qgm_3, round({sql_jaccard('ldw', 'rdw')}, 6) descr_jac_words,
 round(len(list_intersect(ldw, rdw)) / sqrt(len(ldw) * len(rdw)), 6) descr_cos_words,
 (lp = rp)::int::double price_exact, round(abs(lp - rp), 6) price_abs_diff, round(abs(lp - rp) / greatest(abs(lp), abs(rp)), 6) price_rel_diff from f""")
def feature_vectors(spark, sf):
    recs = part_records(spark, sf)
    features = mt.default_features(recs, recs, ("p_partkey", "p_partkey"), long_columns=("descr",))
    out = mt.extract_features(next_parts(recs), features)
    return out.select("id_1", "id_2", *[r6(c).alias(c) for c in features])


@reg.query("feature_jaccard", f"{PAIRED} select id_1, id_2, round({sql_jaccard(sql_tokens('ld'), sql_tokens('rd'))}, 6) both_words from p")
def feature_jaccard(spark, sf):
    jac = tx.set_jaccard(tx.tokens(F.col("l_descr")), tx.tokens(F.col("r_descr")))
    features = mt.add_feature({}, "both_words", F.round(jac, 6))
    return mt.extract_features(next_parts(part_records(spark, sf)), features)


# --- learning --------------------------------------------------------------------------


def labelled_features(spark, sf):
    """Passage/document pairs with 12 common words; a match holds 80 % of the passage's words."""
    a = table(spark, sf, "benchmark").select("item_id", "text")
    b = table(spark, sf, "documents").select("doc_id", "text")
    pairs = bl.overlap_blocking(a, b, "item_id", "doc_id", "text", "text", overlap_size=12)
    # Word and gram sets are built once per record, not once per pair.
    sets = [tx.tokens(F.col("text")).alias("words"), F.array_distinct(tx.qgrams(F.lower("text"), 3)).alias("grams")]
    a, b = cut(a.select("item_id", *sets), "sets"), cut(b.select("doc_id", *sets), "sets")
    joined = mt.with_records(pairs, a, b, "item_id", "doc_id")
    lw, rw = F.col("l_words"), F.col("r_words")
    features = {
        "jac_words": tx.set_jaccard(lw, rw),
        "cos_words": tx.set_cosine(lw, rw),
        "jac_qgm_3": tx.set_jaccard(F.col("l_grams"), F.col("r_grams")),
        "size_ratio": F.size(lw) / F.size(rw),
    }
    label = (F.col("overlap") >= 0.8 * F.size(lw)).cast("int")
    return cut(mt.extract_features(joined.withColumn("label", label), features), "features")


def train_test(spark, sf):
    data = pr.split_train_test(labelled_features(spark, sf), ["id_1", "id_2"], 0.7)
    return data.where("part = 'train'").drop("part"), data.where("part = 'test'").drop("part")


@reg.query("linker_scores")
def linker_scores(spark, sf):
    train, test = train_test(spark, sf)
    return ln.score_linker(ln.train_linker(train), test)


@reg.query("uncertain_pairs", """select l_suppkey id_1, l_partkey id_2, avg(l_quantity) / 50 score from lineitem group by all
order by round(abs(avg(l_quantity) / 50 - 0.5), 9), id_1, id_2 limit 50""")
def uncertain_pairs(spark, sf):
    scored = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id_1"), F.col("l_partkey").alias("id_2")).agg((F.avg("l_quantity") / 50).alias("score"))
    return ln.uncertain_pairs(scored, 50)


@reg.query("matchers_predict")
def matchers_predict(spark, sf):
    train, test = train_test(spark, sf)
    return ln.matcher_predictions(train, test).select("matcher", "id_1", "id_2", "label", "prediction")


@reg.query("select_matcher")
def select_matcher(spark, sf):
    return ln.select_matcher(labelled_features(spark, sf))


@reg.query("debug_pairs")
def debug_pairs(spark, sf):
    train, test = train_test(spark, sf)
    return ln.debug_pairs(ln.train_matcher(train, "LinReg"), test)


# --- pipelines and quality -------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F]', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '[0-9]+', '', 'g')"
CLEAN_CC = rf"""select side, id, array_to_string(list_filter(string_split_regex({_CLEAN}, '\s+'), lambda z: z <> '' and not list_contains({pr.STOP_WORDS}, z)), ' ') as text from ({CC})"""


@reg.query("resolve_entities", f"""with {sql_raw(CLEAN_CC)}, {sql_filtered('raw', True)}, {sql_edges(True)}, w as (select id_1, id_2, {FORMULA['EJS']} weight from j),
pairs as (select id_1, id_2 from w where weight >= (select avg(weight) from w) * {SL}), {sql_vectors(CLEAN_CC, GRAMS)},
sc as (select p.id_1, p.id_2, sum(a.weight * b.weight) dot from pairs p
  join v a on a.side = 1 and a.id = p.id_1 join v b on b.side = 2 and b.id = p.id_2 and b.token = a.token group by all)
select id_1::varchar id_1, id_2::varchar id_2, round(dot, 6) score, 'entity' id_type from sc where dot > 0""")
def resolve_entities(spark, sf):
    out = run_resolve(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", ["text"], ["text"])
    return out.withColumn("score", r6("score"))


@reg.query("auto_er")
def auto_er(spark, sf):
    return run_auto_er(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", exclude=("n_chars",), threshold=0.2)


@reg.query("evaluate_matches", """
with p as (select l_suppkey id_1, l_partkey id_2, max(l_extendedprice) score, max((l_returnflag = 'A')::int) hit from lineitem group by all),
r as (select *, row_number() over (order by score desc, id_1, id_2) rank, count(*) over () n from p where score > 30000),
t as (select count(*) predicted, sum(hit)::bigint correct, (select sum(hit)::bigint from p) truth,
 avg(case when rank <= ceil(n * 10 / 100.0) then hit end) precision_top_10 from r)
select predicted, correct, truth, round(precision_top_10, 6) precision_top_10, round(correct / predicted::double, 6) "precision", round(correct / truth::double, 6) recall,
 round(2 * (correct / predicted::double) * (correct / truth::double) / (correct / predicted::double + correct / truth::double), 6) f1 from t""")
def evaluate_matches(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id_1"), F.col("l_partkey").alias("id_2"), "l_extendedprice", "l_returnflag")
    pred = line.groupBy("id_1", "id_2").agg(F.max("l_extendedprice").alias("score")).where("score > 30000")
    out = mt.evaluate_matches(pred, line.where("l_returnflag = 'A'"), (10,))
    return out.select("predicted", "correct", "truth", *[r6(c).alias(c) for c in ("precision_top_10", "precision", "recall", "f1")])


# --- clustering ------------------------------------------------------------------------


def turn_edges(spark, sf, **choice):
    return meta.edge_weights(turn_blocks(spark, sf), "JS", **choice).withColumn("weight", F.round("weight", 9))


def cc_edges(spark, sf):
    return meta.edge_weights(cc_blocks(spark, sf), "JS", clean_clean=True).withColumn("weight", F.round("weight", 9))


TURN_EDGES = f"{JS}, g as (select id_1, id_2, round(weight, 9) weight from w)"
CC_EDGES = f"{sql_weights('JS', True)}, g as (select id_1, id_2, round(weight, 9) weight from w)"


@reg.query("cl_components", TURN_EDGES.replace("with ", "with recursive ", 1) + """,
n as (select id_1 a, id_2 b from g where weight > 0.05 union select id_2, id_1 from g where weight > 0.05),
r as (select a, a b from n union select r.a, n.b from r join n on n.a = r.b)
select a id, min(b) "cluster" from r group by 1""")
def cl_components(spark, sf):
    return cl.connected_components(turn_edges(spark, sf, only="connecting", threshold=0.05, decimals=9), 0.05)


@reg.query("cl_best_match", f"""{CC_EDGES} select id_1, id_2, weight from g where weight > 0.01
qualify row_number() over (partition by id_1 order by weight desc, id_2) = 1""")
def cl_best_match(spark, sf):
    return cl.best_match(cc_edges(spark, sf), 0.01)


@reg.query("cl_exact", f"""{CC_EDGES} select id_1, id_2, weight from g where weight > 0.01
qualify row_number() over (partition by id_1 order by weight desc, id_2) = 1 and row_number() over (partition by id_2 order by weight desc, id_1) = 1""")
def cl_exact(spark, sf):
    return cl.exact(cut(cc_edges(spark, sf), "edges"), 0.01)


@reg.query("cl_row_column")
def cl_row_column(spark, sf):
    return cl.row_column(cc_edges(spark, sf), 0.01)


@reg.query("cl_kiraly")
def cl_kiraly(spark, sf):
    return cl.kiraly(cc_edges(spark, sf), 0.01)


@reg.query("cl_unique_mapping")
def cl_unique_mapping(spark, sf):
    return cl.unique_mapping(cc_edges(spark, sf), 0.01)


@reg.query("link_one_to_one")
def link_one_to_one(spark, sf):
    return cl.link_one_to_one(cc_edges(spark, sf).withColumnRenamed("weight", "score"), 0.02)


@reg.query("cl_center")
def cl_center(spark, sf):
    return cl.center(turn_edges(spark, sf), 0.05)


@reg.query("cl_merge_center")
def cl_merge_center(spark, sf):
    return cl.merge_center(turn_edges(spark, sf), 0.05)


@reg.query("cl_correlation")
def cl_correlation(spark, sf):
    return cl.correlation(turn_edges(spark, sf), 0.05)


@reg.query("cl_markov")
def cl_markov(spark, sf):
    return cl.markov(turn_edges(spark, sf), 0.15)
