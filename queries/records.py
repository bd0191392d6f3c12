"""Sources, sinks, cleaning, profiling, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, r6, table
from tripleweave.functions import text as tx
from tripleweave.operators import prepare as pr
from tripleweave.operators.schema import match_cells_jaccard
from tripleweave.plans.rounds import new_path
from tripleweave.sources import records as rd
from tripleweave.sources import sinks

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg.query("io_csv_roundtrip", """select c_custkey::varchar c_custkey, c_name, c_nationkey::varchar c_nationkey,
c_mktsegment, case when c_acctbal < 0 then '' else 'a "quoted", value' end note from customer""")
def io_csv_roundtrip(spark, sf):
    path = new_path(spark, "csv")
    note = F.when(F.col("c_acctbal") < 0, "").otherwise('a "quoted", value').alias("note")
    out = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", note)
    out.write.option("header", True).option("escape", '"').csv(path)
    return rd.read_records(spark, path)


@reg.query("cap_rows", "select * from documents order by doc_id limit 500")
def cap_rows(spark, sf):
    return rd.cap_rows(table(spark, sf, "documents"), 500, ["doc_id"])


@reg.query("key_check", """select 'customer' t, count(*) rows, count(distinct c_custkey) distinct_keys, 0::bigint missing, true is_key from customer
union all select 'lineitem', count(*), count(distinct l_orderkey), 0, false from lineitem
union all select 'events', count(*), count(*), 0, true from events""")
def key_check(spark, sf):
    parts = [("customer", "c_custkey"), ("lineitem", "l_orderkey")]
    out = None
    for name, key in parts:
        df, key = rd.with_key(table(spark, sf, name), key)
        part = rd.check_key(df, key).select(F.lit(name).alias("t"), "*")
        out = part if out is None else out.unionByName(part)
    generated, key = rd.with_key(table(spark, sf, "events").select("event_type", "value"), "id")
    return out.unionByName(rd.check_key(generated, key).select(F.lit("events").alias("t"), "*"))


@reg.query("pairwise_tables", """
with l as (select distinct 'customer' t, 'c_nationkey' c, c_nationkey::varchar v from customer
  union all select distinct 'customer', 'c_mktsegment', c_mktsegment from customer
  union all select distinct 'part', 'p_size', p_size::varchar from part),
r as (select distinct 'supplier' t, 's_nationkey' c, s_nationkey::varchar v from supplier
  union all select distinct 'supplier', 's_name', s_name from supplier),
n as (select t, c, count(*) n from (select * from l union all select * from r) group by all),
i as (select l.t t1, l.c c1, r.t t2, r.c c2, count(*) s from l join r using (v) group by all)
select t1 table_1, c1 column_1, t2 table_2, c2 column_2, round(s / (a.n + b.n - s), 6) score
from i join n a on a.t = t1 and a.c = c1 join n b on b.t = t2 and b.c = c2""")
def pairwise_tables(spark, sf):
    left, right = new_path(spark, "left"), new_path(spark, "right")
    def put(name, cols, base):
        table(spark, sf, name).select(*cols).coalesce(1).write.option("header", True).csv(f"{base}/{name}")

    put("customer", ["c_nationkey", "c_mktsegment"], left)
    put("part", ["p_size"], left)
    put("supplier", ["s_nationkey", "s_name"], right)
    out = rd.pairwise_tables(spark, left, right, lambda a, b: match_cells_jaccard(a, b, 0.0))
    folder = lambda c: F.element_at(F.split(c, "/"), -2)
    return out.select(
        folder("table_1").alias("table_1"), "column_1", folder("table_2").alias("table_2"), "column_2", r6("score").alias("score")
    )


@reg.query("read_texts", "select page_id, html text from pages")
def read_texts(spark, sf):
    path = new_path(spark, "texts")
    table(spark, sf, "pages").select("page_id", F.col("html").alias("value")).repartition(8, "page_id").write.partitionBy("page_id").text(path)
    docs = rd.read_texts(spark, path)
    return docs.select(
        F.regexp_extract("doc_id", r"page_id=(\d+)", 1).cast("bigint").alias("page_id"), F.regexp_replace("text", r"\n\z", "").alias("text")
    )


@reg.query("nt_roundtrip", """select 'urn:doc/' || doc_id s, 'urn:text' p, text o, true o_is_literal, false malformed from documents
union all select 'urn:doc/' || doc_id, 'urn:source', 'urn:source/' || source, false, false from documents""")
def nt_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    iri = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    triples = docs.select(iri("urn:doc/", "doc_id").alias("s"), F.lit("urn:text").alias("p"), F.col("text").alias("o"), F.lit(True).alias("o_is_literal")).unionByName(
        docs.select(iri("urn:doc/", "doc_id").alias("s"), F.lit("urn:source").alias("p"), iri("urn:source/", "source").alias("o"), F.lit(False).alias("o_is_literal"))
    )
    path = new_path(spark, "nt")
    rd.format_ntriples(triples).write.text(path)
    return rd.read_ntriples(spark, path).select("s", "p", "o", "o_is_literal", "malformed")


@reg.query("seed_alignment", """select 'urn:c/' || l_suppkey e1, 'urn:p/' || l_partkey e2,
max(case when l_returnflag = 'A' then 1.0 else l_discount end)::double score from lineitem group by all""")
def seed_alignment(spark, sf):
    """Lines are written best score last, so the last line of a pair holds its largest score."""
    line = table(spark, sf, "lineitem")
    score = F.when(F.col("l_returnflag") == "A", F.lit(1.0)).otherwise(F.col("l_discount"))
    text = F.concat(
        F.lit("urn:c/"), "l_suppkey", F.lit("\turn:p/"), "l_partkey",
        F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.concat(F.lit("\t"), F.col("l_discount").cast("string"))),
    )
    path = new_path(spark, "seeds")
    line.select(text.alias("value"), score.alias("x"), "l_suppkey", "l_partkey").repartitionByRange(
        4, "l_suppkey", "l_partkey"
    ).sortWithinPartitions("l_suppkey", "l_partkey", "x").select("value").write.text(path)
    return rd.read_seed_alignment(spark, path)


LABELLED = """with p as (select p_partkey, p_name, p_retailprice, lead(p_partkey) over (order by p_partkey) n from part)
select a.p_partkey::varchar l, b.p_partkey::varchar r, a.p_name l_title, b.p_name r_title, a.p_retailprice l_price,
  (a.p_name = b.p_name)::int label from p a join part b on b.p_partkey = a.n"""


@reg.query("labelled_pairs", LABELLED)
def labelled_pairs(spark, sf):
    part = table(spark, sf, "part")
    rec = lambda t: F.struct(F.col(f"{t}.p_partkey").cast("string").alias("unique_id"), F.col(f"{t}.p_name").alias("title"), F.col(f"{t}.p_retailprice").alias("price"))
    pairs = part.alias("a").join(part.alias("b"), F.expr("b.p_partkey = a.p_partkey + 1"))
    pair = F.struct(F.lit("tuple").alias("__class__"), F.array(rec("a"), rec("b")).alias("__value__"))
    same = F.col("a.p_name") == F.col("b.p_name")
    docs = pairs.groupBy(F.col("a.p_brand"), (F.col("a.p_partkey") / 1000).cast("int")).agg(
        F.collect_list(F.when(same, pair)).alias("match"), F.collect_list(F.when(~same, pair)).alias("distinct")
    )
    path = new_path(spark, "labelled")
    docs.select("match", "distinct").write.json(path)
    out = rd.read_labelled_pairs(spark, path, "unique_id string, title string, price double", multi_line=False)
    return out.select(
        F.col("left.unique_id").alias("l"), F.col("right.unique_id").alias("r"), F.col("left.title").alias("l_title"),
        F.col("right.title").alias("r_title"), F.col("left.price").alias("l_price"), "label",
    )


MATCHES = "select s_suppkey id_1, c_custkey id_2, (s_nationkey + 1) / 32.0::double score from supplier join customer on c_custkey = s_suppkey"


def matches(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return s.join(c, F.col("c_custkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("id_1"), F.col("c_custkey").alias("id_2"), ((F.col("s_nationkey") + 1) / 32.0).alias("score")
    )


@reg.query("match_document", f"select id_1::varchar id_1, id_2::varchar id_2, score::double score, 'entity' id_type from ({MATCHES})")
def match_document(spark, sf):
    path = new_path(spark, "matches")
    sinks.write_match_json(matches(spark, sf), path)
    return spark.read.schema("id_1 string, id_2 string, score double, id_type string").json(path)


@reg.query("clustered_output", """select s_suppkey::varchar s_suppkey, s_name, null::varchar c_custkey, null::varchar c_name,
 (case when c_custkey is not null then s_suppkey end)::varchar "Cluster ID", (case when c_custkey is not null then 0.5 end)::varchar "Link Score", '0' "source file"
 from supplier left join customer on c_custkey = s_suppkey and c_nationkey = s_nationkey
union all select null, null, c_custkey::varchar, c_name, (case when s_suppkey is not null then c_custkey end)::varchar,
 (case when s_suppkey is not null then 0.5 end)::varchar, '1' from customer left join supplier on c_custkey = s_suppkey and c_nationkey = s_nationkey""")
def clustered_output(spark, sf):
    s, c = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    links = s.join(c, (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).select(
        F.col("s_suppkey").alias("id_1"), F.col("c_custkey").alias("id_2"), F.col("s_suppkey").alias("cluster_id"), F.lit(0.5).alias("score")
    )
    path = new_path(spark, "clustered")
    sinks.write_clustered_csv(s.drop("s_nationkey"), c.drop("c_nationkey"), links, "s_suppkey", "c_custkey", path)
    return spark.read.option("header", True).csv(path)


@reg.query("alignment_lines", """select 'urn:' || p_brand || ' rdfs:subPropertyOf urn:' || p_type || ' .# ' || n / 64.0 line from
 (select p_brand, p_type, count(*) n from part group by all) where n / 64.0::double > 0.1
union all select 'urn:s/' || id_1 || ' owl:sameAs urn:c/' || id_2 || ' .# ' || score from (""" + MATCHES + ")")
def alignment_lines(spark, sf):
    preds = table(spark, sf, "part").groupBy("p_brand", "p_type").agg((F.count("*") / 64.0).alias("score")).select(
        F.concat(F.lit("urn:"), "p_brand").alias("p1"), F.concat(F.lit("urn:"), "p_type").alias("p2"), "score"
    )
    same = matches(spark, sf).select(F.concat(F.lit("urn:s/"), "id_1").alias("e1"), F.concat(F.lit("urn:c/"), "id_2").alias("e2"), "score")
    path = new_path(spark, "alignment")
    sinks.write_alignment(preds, same, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@reg.query("links_tsv", f"select '<' || id_1 || '>' s, '<' || id_2 || '>' t, score::double score from ({MATCHES})")
def links_tsv(spark, sf):
    path = new_path(spark, "links")
    sinks.write_links_tsv(matches(spark, sf), path)
    return spark.read.schema("s string, t string, score double").option("sep", "\t").csv(path)


@reg.query("exchange_union", f"""select id_1::varchar subject, 'owl:sameAs' predicate, id_2::varchar object, null::bigint "start", null::bigint length, score::double score, 'matcher' source from ({MATCHES})
union all select 'urn:n/' || n_nationkey, 'urn:region', 'urn:r/' || n_regionkey, null, null, null, 'nations' from nation
union all select doc_id::varchar, 'mentions', lang, 0, n_chars, 1.0, 'languages' from documents""")
def exchange_union(spark, sf):
    nat = table(spark, sf, "nation").select(
        F.concat(F.lit("urn:n/"), "n_nationkey").alias("s"), F.lit("urn:region").alias("p"), F.concat(F.lit("urn:r/"), "n_regionkey").alias("o")
    )
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("entity"), F.lit(0).alias("start"), F.col("n_chars").alias("length"), F.lit(1.0).alias("score"))
    return (
        sinks.to_exchange(matches(spark, sf), "matches", "matcher")
        .unionByName(sinks.to_exchange(nat, "triples", "nations"))
        .unionByName(sinks.to_exchange(docs, "mentions", "languages"))
    )


# --- cleaning --------------------------------------------------------------------------

_SRC, _DST, _LONG = tx.latin_fold_tables()


def sql_fold(expr: str) -> str:
    out = f"translate({expr}, '{_SRC.replace(chr(39), chr(39) * 2)}', '{_DST.replace(chr(39), chr(39) * 2)}')"
    for char, spelling in _LONG.items():
        out = f"replace({out}, '{char}', '{spelling}')"
    return out


def sql_clean(expr: str) -> str:
    out = f"regexp_replace(translate({sql_fold(expr)}, chr(10) || '/:-'',', '   '), ' {{2,}}', ' ', 'g')"
    for chars in (r"\s", '"', "''"):
        out = f"regexp_replace({out}, '^{chars}+|{chars}+$', '', 'g')"
    return rf"nullif(regexp_replace(lower({out}), '^\s+|\s+$', '', 'g'), '')"


@reg.query("clean_values", f"select doc_id, {sql_clean('text')} cleaned from documents")
def clean_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_value(F.col("text")).alias("cleaned"))


@reg.query("parse_price", """select p_partkey, p_retailprice price from part
union all select c_custkey + 1000000000, null from customer""")
def parse_price(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("t"))
    none = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000000).alias("p_partkey"), F.lit(None).cast("string").alias("t"))
    return part.unionByName(none).select("p_partkey", tx.parse_price(F.col("t")).alias("price"))


@reg.query("clean_docs", r"""
with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F]', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '[0-9]+', '', 'g') t from documents)
select doc_id, array_to_string(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '' and not list_contains(%s, w)), ' ') "text" from c""" % str(pr.STOP_WORDS))
def clean_docs(spark, sf):
    return pr.clean_for_matching(table(spark, sf, "documents").select("doc_id", "text"), "text")


@reg.query("normalise_text", r"""select conv_id, turn, translate(lower(substr(text, 1, 1)) || substr(text, 2), '?.!\#', '') q from conversations""")
def normalise_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.normalise_question(F.col("text")).alias("q"))


def _sql_profile(col: str, numeric: bool) -> str:
    x = f"{col}::double" if numeric else "null::double"
    return f"""select '{col}' "column", count(*) "rows", (count(*) - count({col}))::bigint nulls, count(distinct {col}) "distinct",
      min({col}::varchar) min_text, max({col}::varchar) max_text, min({x}) min_number, max({x}) max_number,
      round(avg({x}), 4) mean, round(stddev_samp({x}), 4) std,
      (select string_agg(v, ' | ' order by n desc, v) from (select {col}::varchar v, count(*) n from customer group by 1 order by n desc, v limit 3)) top_values
      from customer"""


@reg.query("profile_customer", " union all ".join(_sql_profile(c, c in ("c_custkey", "c_nationkey", "c_acctbal")) for c in
           ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def profile_customer(spark, sf):
    out = pr.profile(table(spark, sf, "customer"))
    return out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@reg.query("down_sample")
def down_sample(spark, sf):
    a, b = pr.down_sample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id", 20, 3)
    return a.select(F.lit("a").alias("side"), F.col("doc_id").alias("id")).unionByName(b.select(F.lit("b").alias("side"), F.col("item_id").alias("id")))


@reg.query("split_train_test")
def split_train_test(spark, sf):
    return pr.split_train_test(table(spark, sf, "labels"), ["doc_id"], 0.7).groupBy("part", "quality").count()


@reg.query("impute_mean", """with x as (select p_partkey, case when p_size > 40 then null else p_size end s, case when p_type = 'PROMO' then null else p_retailprice end r from part)
select p_partkey, round(coalesce(s::double, avg(s) over ()), 6) s, round(coalesce(r, avg(r) over ()), 6) r from x""")
def impute_mean(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("s"), F.when(F.col("p_type") != "PROMO", F.col("p_retailprice")).alias("r")
    )
    return pr.impute_mean(part, ("p_partkey",)).withColumn("s", r6("s")).withColumn("r", r6("r"))
