"""Mentions, linking and extraction over conversations, documents, pages and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, r6, sql_words, table
from queries.records import sql_fold
from tripleweave.functions import text as tx
from tripleweave.operators import extract as ex
from tripleweave.operators import linking as lk
from tripleweave.operators import mentions as mn
from tripleweave.operators.prepare import STOP_WORDS
from tripleweave.plans.linking import link_texts
from tripleweave.plans.rounds import cut

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

COMPARE = ["ou", "er", "th"]


def turns(spark, sf):
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")


def questions(spark, sf):
    return turns(spark, sf).select("doc_id", tx.normalise_question(F.col("text")).alias("text"))


def verbs(spark, sf):
    """Verb lexicon: words of the benchmark texts that end in -ed or -ing."""
    words = table(spark, sf, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("w"))
    return words.where("w RLIKE '.(ed|ing)$'").distinct()


def tokens(spark, sf):
    return mn.annotate_tokens(questions(spark, sf), STOP_WORDS, verbs(spark, sf))


def properties(spark, sf):
    """Words of four to six letters of the benchmark texts."""
    words = table(spark, sf, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("label")).distinct()
    return words.where("length(label) BETWEEN 4 AND 6").select(
        F.concat(F.lit("P:"), "label").alias("uri"), "label", (F.ascii("label") * 10 + F.length("label")).cast("bigint").alias("numeric_id")
    )


def entities(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("label")).distinct()
    return words.where("length(label) >= 7").select(
        F.concat(F.lit("E:"), "label").alias("uri"), "label", (F.ascii("label") * 10 + F.length("label")).cast("bigint").alias("numeric_id")
    )


def word_facts(spark, sf):
    """Three words in a row of a benchmark text as subject, predicate, object."""
    w = tx.words(F.col("text"))
    rows = table(spark, sf, "benchmark").select(w.alias("a"), F.slice(w, 2, 1 << 30).alias("b"), F.slice(w, 3, 1 << 30).alias("c"))
    t = rows.select(F.explode(F.arrays_zip("a", "b", "c")).alias("t")).select("t.*").where("b IS NOT NULL AND c IS NOT NULL")
    return t.select(F.concat(F.lit("E:"), "a").alias("s"), F.concat(F.lit("P:"), "b").alias("p"), F.concat(F.lit("E:"), "c").alias("o")).distinct()


SHOWN = ["doc_id", "chunk_no", "start", "end", "chunk"]
STOPS = str(STOP_WORDS)
Q = r"q as (select conv_id || '-' || turn doc_id, translate(lower(substr(text, 1, 1)) || substr(text, 2), '?.!\#', '') txt from conversations)"
VERBS = f"verbs as (select distinct w from (select unnest({sql_words('text')}) w from benchmark) where regexp_matches(w, '.(ed|ing)$'))"


def sql_tokens_of(src: str = "q") -> str:
    return f"""tk0 as (select doc_id, unnest(l) token, generate_subscripts(l, 1) - 1 pos from (select doc_id, list_filter(string_split_regex(txt, '\\s+'), lambda t: t <> '') l from {src})),
    tk as (select doc_id, pos, token, lower(token) low, list_contains({STOPS}, lower(token)) and lower(token) <> 'name' is_stop,
      lower(token) in (select w from verbs) and not (list_contains({STOPS}, lower(token)) and lower(token) <> 'name') is_verb,
      token = upper(token) and token <> lower(token) is_upper, list_contains({mn.DETERMINERS}, lower(token)) is_det from tk0)"""


def sql_islands(brk: str, src: str = "tk", out: str = "ch") -> str:
    """Chunks of tokens between breaks; single words where a text has no stop word."""
    return f"""{out}_r as (select *, bool_or(is_stop) over (partition by doc_id) has, sum(({brk})::int) over (partition by doc_id order by pos) g from {src}),
    {out} as (select doc_id, row_number() over (partition by doc_id order by min(pos)) chunk_no, min(pos) "start", max(pos) "end", string_agg(token, ' ' order by pos) chunk, bool_or(is_verb) has_verb
      from {out}_r where not ({brk}) group by doc_id, case when has then g else pos end)"""


BASE = f"with {Q}, {VERBS}, {sql_tokens_of()}"
CHUNKS = f"{BASE}, {sql_islands('is_stop')}"


@reg.query("lk_tokens", f"{BASE} select doc_id, pos, token, low \"lower\", is_stop, is_verb, is_upper, is_det from tk")
def lk_tokens(spark, sf):
    return tokens(spark, sf)


def chunks(spark, sf):
    return mn.chunk_compounds(tokens(spark, sf))


@reg.query("lk_compounds", f"{CHUNKS} select doc_id, chunk_no, \"start\", \"end\", chunk from ch")
def lk_compounds(spark, sf):
    return chunks(spark, sf).select(*SHOWN)


@reg.query("lk_verbs", f"{BASE}, {sql_islands('is_stop or is_verb')} select doc_id, chunk_no, \"start\", \"end\", chunk from ch")
def lk_verbs(spark, sf):
    return mn.split_on_verbs(chunks(spark, sf))[0].select(*SHOWN)


@reg.query("lk_verb_phrases", f"{BASE} select doc_id, pos \"start\", token phrase from tk where is_verb")
def lk_verb_phrases(spark, sf):
    return mn.split_on_verbs(chunks(spark, sf))[1]


QP = Q.replace("from conversations", "from (select conv_id, turn, replace(text, ' of ', '''s ') as text from conversations)")


@reg.query("lk_possessive", f"""with {QP}, {VERBS}, {sql_tokens_of()}, {sql_islands('is_stop')}
select doc_id, trim(x) chunk from (select doc_id, unnest(string_split(chunk, '''s')) x from ch) where trim(x) <> ''""")
def lk_possessive(spark, sf):
    t = turns(spark, sf).withColumn("text", F.replace("text", F.lit(" of "), F.lit("'s ")))
    toks = mn.annotate_tokens(t.select("doc_id", tx.normalise_question(F.col("text")).alias("text")), STOP_WORDS, verbs(spark, sf))
    return mn.split_possessive(mn.chunk_compounds(toks)).select("doc_id", "chunk")


@reg.query("lk_merge")
def lk_merge(spark, sf):
    toks = cut(tokens(spark, sf), "tokens")
    merged, relations = mn.merge_over_stopwords(mn.chunk_compounds(toks), toks, properties(spark, sf).select("label"))
    return merged.select("doc_id", "start", F.lit("entity").alias("kind"), "chunk").unionByName(
        relations.select("doc_id", "start", F.lit("relation").alias("kind"), F.col("phrase").alias("chunk"))
    )


PROPS = f"props as (select distinct w from (select unnest({sql_words('text')}) w from benchmark) where length(w) between 4 and 6)"
CAP = "upper(substr(chunk, 1, 1)) || lower(substr(chunk, 2))"


@reg.query("lk_mark_entities", f"""{CHUNKS}, {PROPS}, m as (select *, not exists (select 1 from props where list_contains({sql_words('chunk')}, w))
  and not (substr(chunk, 1, 1) = upper(substr(chunk, 1, 1)) and substr(chunk, 1, 1) <> lower(substr(chunk, 1, 1))) is_entity from ch)
select doc_id, chunk_no, "start", "end", case when is_entity then {CAP} else chunk end chunk, is_entity from m""")
def lk_mark_entities(spark, sf):
    return mn.mark_entities(chunks(spark, sf), properties(spark, sf).select("label")).select(*SHOWN, "is_entity")


@reg.query("lk_comparison", f"""{CHUNKS}, hc as (select ch.*, tk.pos, tk.token, tk.low, tk.is_stop, tk.is_verb from ch join tk on tk.doc_id = ch.doc_id and tk.pos between "start" and "end"),
hs as (select *, bool_or(list_contains({COMPARE}, low)) over (partition by doc_id, chunk_no) has from hc),
hb as (select *, list_contains({COMPARE + ['than']}, low) and has b from hs), hg as (select *, sum(b::int) over (partition by doc_id, chunk_no order by pos) g from hb),
o as (select doc_id, min(pos) "start", max(pos) "end", string_agg(token, ' ' order by pos) chunk from hg where not b group by doc_id, chunk_no, g)
select doc_id, row_number() over (partition by doc_id order by "start", "end", chunk) chunk_no, "start", "end", chunk from o""")
def lk_comparison(spark, sf):
    return mn.split_on_comparison(chunks(spark, sf), COMPARE).select(*SHOWN)


QD = r"q as (select doc_id, translate(lower(substr(text, 1, 1)) || substr(text, 2), '?.!\#', '') txt from documents)"


@reg.query("lk_abbrev", f"""with {QD}, {VERBS}, {sql_tokens_of()}, {sql_islands('is_stop')},
hc as (select ch.doc_id, ch.chunk_no, tk.pos, tk.token, tk.is_upper u from ch join tk on tk.doc_id = ch.doc_id and tk.pos between "start" and "end"),
hx as (select *, u::int + lag(u::int, 1, 0) over (partition by doc_id, chunk_no order by pos) x from hc),
hg as (select *, sum(x) over (partition by doc_id, chunk_no order by pos) g from hx),
o as (select doc_id, min(pos) "start", max(pos) "end", string_agg(token, ' ' order by pos) chunk from hg group by doc_id, chunk_no, g)
select doc_id, row_number() over (partition by doc_id order by "start") chunk_no, "start", "end", chunk from o""")
def lk_abbrev(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.normalise_question(F.col("text")).alias("text"))
    toks = mn.annotate_tokens(docs, STOP_WORDS, verbs(spark, sf))
    return mn.extract_abbreviations(mn.chunk_compounds(toks)).select(*SHOWN)


@reg.query("lk_person")
def lk_person(spark, sf):
    """Names: the capitalised words that open the passages of the benchmark."""
    names = table(spark, sf, "benchmark").select(F.substring_index("text", " ", 1).alias("name"))
    return mn.split_on_person(chunks(spark, sf), names)[0].select(*SHOWN)


@reg.query("lk_relations", f"{CHUNKS}, {PROPS} select doc_id, \"start\", chunk phrase from ch where lower(trim(chunk)) in (select w from props)")
def lk_relations(spark, sf):
    return mn.extract_relations(chunks(spark, sf), properties(spark, sf).select("label"))[1]


@reg.query("lk_case", f"""{CHUNKS}, c as (select *, case when has_verb then lower(chunk) else {CAP} end cased from ch)
select doc_id, chunk_no, "start", "end", cased chunk from c qualify row_number() over (partition by doc_id, lower(cased) order by "start", chunk_no) = 1""")
def lk_case(spark, sf):
    return mn.case_chunks(chunks(spark, sf)).select(*SHOWN)


@reg.query("lk_determiner", f"""{CHUNKS}, c as (select *, case when has_verb then lower(chunk) else {CAP} end cased from ch),
f as (select * from c qualify row_number() over (partition by doc_id, lower(cased) order by "start", chunk_no) = 1),
d as (select f.*, t.token det from f left join tk t on t.doc_id = f.doc_id and t.pos = f."start" - 1 and t.is_det)
select doc_id, chunk_no, "start", "end", case when det is not null and lower(cased) <> upper(cased)
  and cased = array_to_string(list_transform(string_split(cased, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')
  then upper(substr(det, 1, 1)) || lower(substr(det, 2)) || ' ' || cased else cased end chunk from d""")
def lk_determiner(spark, sf):
    toks = tokens(spark, sf)
    return mn.merge_determiner(mn.case_chunks(mn.chunk_compounds(toks)), toks).select(*SHOWN)


# --- candidates ------------------------------------------------------------------------


def sql_bigrams(src: str) -> str:
    w = sql_words(sql_fold("text"))
    return f"select distinct a || ' ' || b x from (select unnest(list_zip(w, w[2:], true)) z, z[1] a, z[2] b from (select {w} w from {src}))"


def bigrams(df):
    w = tx.words(tx.fold_accents(F.col("text")))
    pairs = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return df.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("x")).distinct()


CANDS = f"""m as ({sql_bigrams('benchmark')}), l as (select x, ascii(x) * 10 + length(x) num from ({sql_bigrams('conversations')})),
mw as (select distinct x, unnest(string_split(x, ' ')) w from m), lw as (select distinct x, num, unnest(string_split(x, ' ')) w from l),
pr as (select distinct mw.x mention, lw.x "label", num from mw join lw using (w)),
cand as (select mention, "label", 'C:' || "label" uri, num::bigint numeric_id, round(1 - levenshtein(mention, "label") / greatest(length(mention), length("label"))::double, 9) score, 0 boost from pr
  qualify row_number() over (partition by mention order by score desc, num, uri) <= 5)"""


def candidates(spark, sf):
    labels = bigrams(table(spark, sf, "conversations")).select(
        F.concat(F.lit("C:"), "x").alias("uri"), F.col("x").alias("label"), (F.ascii("x") * 10 + F.length("x")).cast("bigint").alias("numeric_id")
    )
    return lk.search_candidates(bigrams(table(spark, sf, "benchmark")).select(F.col("x").alias("mention")), labels, 5)


@reg.query("lk_candidates", f"with {CANDS} select * from cand")
def lk_candidates(spark, sf):
    return candidates(spark, sf)


LINES = "select l_orderkey doc_id, 'm' || (l_linenumber % 2) mention, 'P:' || l_suppkey uri, l_suppkey numeric_id, l_discount score, l_linenumber rank, 0 boost from lineitem"


def line_candidates(spark, sf):
    """Order lines as candidate lists: suppliers for two mentions of an order."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("m"), F.col("l_linenumber") % 2).alias("mention"),
        F.concat(F.lit("P:"), "l_suppkey").alias("uri"), F.col("l_suppkey").alias("numeric_id"), F.col("l_discount").alias("score"),
        F.col("l_linenumber").alias("rank"), F.lit(0).alias("boost"),
    )


@reg.query("lk_distinct", f"select * from ({LINES}) qualify row_number() over (partition by doc_id, mention, uri order by rank, numeric_id, score) = 1")
def lk_distinct(spark, sf):
    return lk.distinct_relations(line_candidates(spark, sf))


@reg.query("lk_default", f"""select doc_id, 'when' mention, 'time' "label", '<http://www.wikidata.org/wiki/Property:P569>' uri, 569::bigint numeric_id, 0.0::double score, 20 boost, 1 rank
from (select conv_id || '-' || turn doc_id, case when turn % 2 = 0 then 'When ' || text else text end t from conversations)
where lower(split_part(trim(t), ' ', 1)) = 'when' and doc_id not in (select conv_id || '-' || turn from conversations where role = 'system')""")
def lk_default(spark, sf):
    c = table(spark, sf, "conversations")
    key = F.concat_ws("-", "conv_id", "turn").alias("doc_id")
    texts = c.select(key, F.when(F.col("turn") % 2 == 0, F.concat(F.lit("When "), "text")).otherwise(F.col("text")).alias("text"))
    return lk.default_relation(texts, c.where("role = 'system'").select(key))


RERANK = """ent as (select doc_id, mention em, 'P:' || (numeric_id + 1) eu, numeric_id, score, min(rank) er from base where mention = 'm0' group by all),
rel as (select doc_id, mention rm, uri ru, numeric_id, score, min(rank) rr from base where mention = 'm1' group by all),
facts as (select distinct 'P:' || l_suppkey s, 'P:' || (l_partkey % 97) p, 'P:' || (l_orderkey % 89) o from lineitem),
head as (select o_orderkey doc_id, case when o_orderstatus = 'F' then 'who' else 'what' end head from orders),
fw as (select ent.doc_id, em, eu, er, rm, ru, rr from ent join rel using (doc_id) where exists (select 1 from facts where s = eu and p = ru)),
bw as (select ent.doc_id, em, eu, er, rm, ru, rr from ent join rel using (doc_id) where exists (select 1 from facts where o = eu and p = ru)),
ft as (select doc_id, em, rm, min((er, rr)) f from fw group by all),
gain as (select fw.*, case when head = 'who' then 45 else 40 end g from fw join ft using (doc_id, em, rm) join head using (doc_id) where (er, rr) = f
 union all select bw.*, case when head = 'who' then 15 else 12 end from bw left join ft using (doc_id, em, rm) join head using (doc_id)
  where (f is null or (er, rr) < f) and (doc_id, em, eu, er, rm, ru, rr) not in (select (doc_id, em, eu, er, rm, ru, rr) from fw))"""


def rerank(spark, sf):
    base = cut(line_candidates(spark, sf), "base")
    first = lambda df: df.groupBy(*[c for c in df.columns if c != "rank"]).agg(F.min("rank").alias("rank"))
    ents = first(base.where("mention = 'm0'").withColumn("uri", F.concat(F.lit("P:"), F.col("numeric_id") + 1)))
    rels = first(base.where("mention = 'm1'"))
    facts = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P:"), "l_suppkey").alias("s"), F.concat(F.lit("P:"), F.col("l_partkey") % 97).alias("p"), F.concat(F.lit("P:"), F.col("l_orderkey") % 89).alias("o")
    ).distinct()
    heads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "who").otherwise("what").alias("head"))
    return lk.rerank_by_triples(ents, rels, facts, heads)


SUMS = f"""with base as ({LINES}), {RERANK},
eo as (select e.doc_id, em mention, eu uri, numeric_id, score, er rank, coalesce((select sum(g) from gain x where x.doc_id = e.doc_id and x.em = e.em and x.eu = e.eu), 0)::bigint boost from ent e),
ro as (select e.doc_id, rm mention, ru uri, numeric_id, score, rr rank, coalesce((select sum(g) from gain x where x.doc_id = e.doc_id and x.rm = e.rm and x.ru = e.ru), 0)::bigint boost from rel e)"""


@reg.query("lk_rerank", f"{SUMS} select 'entity' kind, * from eo union all select 'relation', * from ro")
def lk_rerank(spark, sf):
    ents, rels = rerank(spark, sf)
    names = ["doc_id", "mention", "uri", "numeric_id", "score", "rank", "boost"]
    return ents.select(F.lit("entity").alias("kind"), *names).unionByName(rels.select(F.lit("relation").alias("kind"), *names))


@reg.query("lk_top", f"""{SUMS}, ra as (select *, max(boost) over (partition by doc_id, mention) > 0 hot from ro),
e1 as (select * from eo qualify row_number() over (partition by doc_id, mention order by boost desc, score desc, numeric_id, uri) <= 1),
r1 as (select * exclude hot from ra qualify row_number() over (partition by doc_id, mention order by boost desc, case when hot then numeric_id end, score desc, numeric_id, uri) <= 1)
select 'entity' kind, * from e1 union all select 'relation', * from r1""")
def lk_top(spark, sf):
    ents, rels = rerank(spark, sf)
    names = ["doc_id", "mention", "uri", "numeric_id", "score", "rank", "boost"]
    return lk.top_entities(ents).select(F.lit("entity").alias("kind"), *names).unionByName(
        lk.top_relations(rels).select(F.lit("relation").alias("kind"), *names)
    )


@reg.query("lk_evaluate", """with p as (select distinct l_orderkey d, l_suppkey u from lineitem where l_discount < 0.06), g as (select distinct l_orderkey d, l_suppkey u from lineitem where l_tax < 0.05),
c as (select coalesce(p.d, g.d) d, count(p.u) np, count(g.u) ng, sum((p.u is not null and g.u is not null)::int)::bigint ok from p full join g on p.d = g.d and p.u = g.u group by 1)
select d doc_id, round(case when np > 0 then ok / np::double else 0 end, 6) "precision", round(case when np > 0 then ok / ng::double else 0 end, 6) recall, ok correct, ng - ok wrong from c where ng > 0""")
def lk_evaluate(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("uri"), "l_discount", "l_tax")
    out = lk.evaluate_linking(line.where("l_discount < 0.06"), line.where("l_tax < 0.05"))
    return out.withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


@reg.query("lk_share", """with g as (select distinct l_orderkey d, l_suppkey u from lineitem where l_tax < 0.05), p as (select distinct l_orderkey d, l_suppkey u from lineitem where l_discount < 0.06)
select count(p.d) correct, count(*) - count(p.d) wrong, round(count(p.d) / count(*)::double, 6) share from g left join p on p.d = g.d and p.u = g.u""")
def lk_share(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("uri"), "l_discount", "l_tax")
    return lk.linking_share(line.where("l_discount < 0.06"), line.where("l_tax < 0.05")).withColumn("share", r6("share"))


@reg.query("lk_pipeline")
def lk_pipeline(spark, sf):
    ents, rels = link_texts(
        turns(spark, sf), entities(spark, sf), properties(spark, sf), word_facts(spark, sf), STOP_WORDS, verbs(spark, sf)
    )
    names = ["doc_id", "mention", "uri", "score", "boost"]
    return ents.select(F.lit("entity").alias("kind"), *names).unionByName(rels.select(F.lit("relation").alias("kind"), *names))


# --- dictionary annotation -------------------------------------------------------------


def anchors(spark, sf):
    """Links of the pages: the text is the surface form, the address the entity."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    surface = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    pairs = table(spark, sf, "pages").select(F.explode(F.arrays_zip(found.alias("entity"), surface.alias("surface"))).alias("x"))
    return pairs.select(F.lower("x.surface").alias("surface"), F.col("x.entity").alias("entity"))


COMMON = """a as (select unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) entity, lower(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))) surface from pages),
n as (select surface, entity, count(*) n from a group by all)"""


@reg.query("el_commonness", f"with {COMMON} select surface, entity, n, round(n / (sum(n) over (partition by surface))::double, 6) prior from n")
def el_commonness(spark, sf):
    return lk.commonness(anchors(spark, sf)).withColumn("prior", r6("prior"))


def entity_texts(spark, sf):
    """What an entity is about: all benchmark passages that have its name."""
    words = table(spark, sf, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("w"), "text")
    return words.select(F.concat(F.lit("/"), "w").alias("entity"), "text").distinct()


@reg.query("el_spot")
def el_spot(spark, sf):
    return lk.spot_mentions(turns(spark, sf), anchors(spark, sf))


@reg.query("el_disambiguate")
def el_disambiguate(spark, sf):
    priors = lk.commonness(anchors(spark, sf))
    return lk.disambiguate(lk.spot_mentions(turns(spark, sf), priors), priors, turns(spark, sf), entity_texts(spark, sf))


@reg.query("el_annotate")
def el_annotate(spark, sf):
    return lk.annotate(turns(spark, sf), anchors(spark, sf), entity_texts(spark, sf), 0.5)


# --- extraction ------------------------------------------------------------------------

SENTENCES = r"""s as (select doc_id, unnest(l) sentence, generate_subscripts(l, 1) - 1 sentence_no from (select conv_id || '-' || turn doc_id,
 list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') l from conversations))"""


@reg.query("ie_sentences", f"""with {SENTENCES} select doc_id, sentence_no, unnest(w) token, generate_subscripts(w, 1) - 1 token_no
from (select doc_id, sentence_no, {sql_words('sentence')} w from s)""")
def ie_sentences(spark, sf):
    return ex.tokens(ex.sentences(turns(spark, sf)))


@reg.query("ie_linearised", f"""with {SENTENCES} select doc_id, w[1] head, array_to_string(w[3:], ' ') "type", w[2] tail
from (select doc_id, {sql_words('sentence')} w from s) where len(w) >= 3""")
def ie_linearised(spark, sf):
    """Sentences written out as model output: first word, second word, the rest as relation."""
    w = F.col("w")
    sents = ex.sentences(turns(spark, sf)).select("doc_id", "sentence_no", tx.words(F.col("sentence")).alias("w")).where(F.size(w) >= 3)
    part = F.concat(F.lit("<triplet> "), w[0], F.lit(" <subj> "), w[1], F.lit(" <obj> "), F.array_join(F.slice(w, 3, 1 << 30), " "))
    texts = sents.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", part.alias("t")))).alias("l"))
    line = F.concat(F.lit("<s>"), F.array_join(F.transform("l", lambda x: x["t"]), " "), F.lit("</s><pad>"))
    return ex.parse_linearised_triples(texts.select("doc_id", line.alias("generated")))


def open_triples(spark, sf):
    return ex.open_triples(turns(spark, sf), STOP_WORDS, verbs(spark, sf))


@reg.query("ie_open_triples")
def ie_open_triples(spark, sf):
    return open_triples(spark, sf)


@reg.query("ie_typed")
def ie_typed(spark, sf):
    """Terms typed by their number of words, verbs by their ending."""
    triples = cut(open_triples(spark, sf), "triples")
    terms = triples.select(F.col("subject").alias("term")).unionAll(triples.select("object")).distinct()
    types = terms.select("term", F.when(F.contains("term", F.lit(" ")), "phrase").otherwise("word").alias("type"))
    v = triples.select(F.col("relation").alias("verb")).distinct()
    patterns = v.select(
        "verb", F.explode(F.array(F.lit("phrase"), F.lit("word"))).alias("subject_type"), F.lit("phrase").alias("object_type"),
        F.when(F.endswith("verb", F.lit("ing")), "doing").otherwise("done").alias("relation"),
    )
    return ex.typed_relations(triples, types, patterns)
