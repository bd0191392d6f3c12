"""Triples from tables, closure, validation, graph views, the triple stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, table
from tripleweave.operators import constraints as cs
from tripleweave.operators import graph as gr
from tripleweave.operators import reason as rs
from tripleweave.operators.schema import OWL, RDF_TYPE, RDFS
from tripleweave.plans.rounds import cut, new_path
from tripleweave.streaming import graph_stream as st

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg.query("triples_from_customer", """with c as (select c_custkey::varchar id, c_name, c_nationkey::varchar c_nationkey, case when c_acctbal < 0 then '' else c_mktsegment end seg from customer)
select 'urn:x/' || id s, 'urn:x/c_name' p, c_name o, true o_is_literal from c union all select 'urn:x/' || id, 'urn:x/c_nationkey', c_nationkey, true from c
union all select 'urn:x/' || id, 'urn:x/seg', seg, true from c""")
def triples_from_customer(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("seg"))
    return gr.table_to_triples(c, "c_custkey", "urn:x/")


MAPPING = [
    {"name": "nation", "source": "nation", "subject": "urn:n/{n_nationkey}", "classes": ["urn:Nation"],
     "objects": [{"predicate": RDFS + "label", "column": "n_name", "lang": "en"}, {"predicate": "urn:region", "template": "urn:r/{n_regionkey}"}]},
    {"name": "customer", "source": "customer", "subject": "urn:c/{c_custkey}", "classes": ["urn:Customer"],
     "objects": [
         {"predicate": RDFS + "label", "column": "c_name"},
         {"predicate": "urn:segment", "column": "c_mktsegment"},
         {"predicate": "urn:source", "constant": "sales"},
         {"predicate": "urn:nationKey", "column": "c_nationkey", "datatype": "http://www.w3.org/2001/XMLSchema#integer"},
         {"predicate": "urn:nation", "parent": "nation", "join": {"c_nationkey": "n_nationkey"}},
     ]},
]
TYPE, LABEL = f"'{RDF_TYPE}'", f"'{RDFS}label'"
RML = f"""select 'urn:n/' || n_nationkey s, {TYPE} p, 'urn:Nation' o, false o_is_literal, null::varchar datatype, null::varchar lang from nation
union all select 'urn:n/' || n_nationkey, {LABEL}, n_name, true, null, 'en' from nation
union all select 'urn:n/' || n_nationkey, 'urn:region', 'urn:r/' || n_regionkey, false, null, null from nation
union all select 'urn:c/' || c_custkey, {TYPE}, 'urn:Customer', false, null, null from customer
union all select 'urn:c/' || c_custkey, {LABEL}, c_name, true, null, null from customer
union all select 'urn:c/' || c_custkey, 'urn:segment', c_mktsegment, true, null, null from customer
union all select 'urn:c/' || c_custkey, 'urn:source', 'sales', true, null, null from customer
union all select 'urn:c/' || c_custkey, 'urn:nationKey', c_nationkey::varchar, true, 'http://www.w3.org/2001/XMLSchema#integer', null from customer
union all select 'urn:c/' || c_custkey, 'urn:nation', 'urn:n/' || n_nationkey, false, null, null from customer join nation on c_nationkey = n_nationkey"""


@reg.query("rml_map", RML)
def rml_map(spark, sf):
    return gr.map_to_triples({n: table(spark, sf, n) for n in ("nation", "customer")}, MAPPING)


@reg.query("graph_nodes", f"""with t as ({RML}), n as (select s id, false literal, null::varchar v, case when p = {TYPE} then o end c, case when p = {LABEL} then o end l from t
union all select case when o_is_literal then s || '::' || p || '::' || o else o end, o_is_literal, case when o_is_literal then o end, null, null from t where p not in ({TYPE}, {LABEL})),
g as (select id, bool_or(literal) literal, max(v) "value", max(c) class_uri, max(l) "label" from n group by 1)
select *, coalesce("label", "value", regexp_extract(id, '([^/#]*)$', 1)) display from g""")
def graph_nodes(spark, sf):
    return gr.graph_nodes(rml_map(spark, sf))


@reg.query("graph_links", f"""with t as ({RML}) select distinct s source, case when o_is_literal then s || '::' || p || '::' || o else o end target, p predicate from t where p not in ({TYPE}, {LABEL})""")
def graph_links(spark, sf):
    return gr.graph_links(rml_map(spark, sf))


@reg.query("graph_to_triples", f"select s, p, o, o_is_literal from ({RML})")
def graph_to_triples(spark, sf):
    t = cut(rml_map(spark, sf), "triples")
    return gr.graph_to_triples(gr.graph_nodes(t), gr.graph_links(t))


@reg.query("suggest", f"""with t as ({RML}), n as (select distinct '<' || s || '>' x from t union select distinct '<' || o || '>' from t where not o_is_literal and p <> {TYPE}
union select distinct o from t where o_is_literal and p <> {LABEL}) select x suggestion from n where contains(lower(x), 'c/12')""")
def suggest(spark, sf):
    return gr.suggest(gr.graph_nodes(rml_map(spark, sf)), "C/12")


def hierarchy(spark, sf):
    """Part names under types under brands, orders linked to what they hold."""
    part = table(spark, sf, "part")
    iri = lambda prefix, c: F.concat(F.lit(prefix), F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("_")))
    tr = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o")).distinct()
    out = tr(part, iri("urn:p/", "p_partkey"), RDF_TYPE, iri("urn:k/", "p_name"))
    last = part.withColumn("w", F.element_at(F.split("p_name", " "), -1))
    out = out.unionByName(tr(last, iri("urn:k/", "p_name"), rs.SUB_CLASS, iri("urn:w/", "w")))
    out = out.unionByName(tr(last, iri("urn:w/", "w"), rs.SUB_CLASS, F.lit("urn:Part")))
    line = table(spark, sf, "lineitem")
    out = out.unionByName(tr(line.where("l_returnflag = 'R'"), iri("urn:s/", "l_suppkey"), "urn:returned", iri("urn:p/", "l_partkey")))
    rules = tr(table(spark, sf, "region").agg(F.count("*")), F.lit("urn:returned"), rs.SUB_PROPERTY, F.lit("urn:sold"))
    for s, p, o in (("urn:sold", rs.DOMAIN, "urn:Seller"), ("urn:sold", rs.RANGE, "urn:Sold"), ("urn:sold", rs.INVERSE_OF, "urn:soldBy")):
        rules = rules.unionByName(tr(table(spark, sf, "region").agg(F.count("*")), F.lit(s), p, F.lit(o)))
    return out.unionByName(rules)


SUB = f"'{rs.SUB_CLASS}'"


@reg.query("rdfs_closure", f"""with recursive line as (select distinct 'urn:s/' || l_suppkey s, 'urn:p/' || l_partkey o from lineitem where l_returnflag = 'R'),
sub as (select distinct 'urn:k/' || replace(p_name, ' ', '_') a, 'urn:w/' || string_split(p_name, ' ')[-1] b from part
  union select distinct 'urn:w/' || string_split(p_name, ' ')[-1], 'urn:Part' from part),
clo as (select a, b from sub union select c.a, s.b from clo c join sub s on s.a = c.b),
ty as (select 'urn:p/' || p_partkey s, 'urn:k/' || replace(p_name, ' ', '_') o from part),
allty as (select s, o from ty union select ty.s, clo.b from ty join clo on clo.a = ty.o)
select s, {TYPE} p, o from allty union select a, {SUB}, b from clo
union select s, 'urn:returned', o from line union select s, 'urn:sold', o from line union select o, 'urn:soldBy', s from line
union select s, {TYPE}, 'urn:Seller' from line union select o, {TYPE}, 'urn:Sold' from line
union values ('urn:returned', '{rs.SUB_PROPERTY}', 'urn:sold'), ('urn:sold', '{rs.DOMAIN}', 'urn:Seller'), ('urn:sold', '{rs.RANGE}', 'urn:Sold'), ('urn:sold', '{rs.INVERSE_OF}', 'urn:soldBy')""")
def rdfs_closure(spark, sf):
    return rs.materialise(hierarchy(spark, sf))


@reg.query("owl_same_as", f"""with c as (select 'urn:c/' || c_custkey node, c_nationkey n from customer), r as (select n, min(node) rep, count(*) k from c group by 1)
select node s, '{OWL}sameAs' p, rep o from c join r using (n) where node <> rep
union select rep, 'urn:livesIn', 'urn:n/' || n from r union select 'urn:o/' || o_orderkey, 'urn:by', rep from orders join c on node = 'urn:c/' || o_custkey join r using (n)
union select rep, 'urn:ordered', 'urn:o/' || o_orderkey from orders join c on node = 'urn:c/' || o_custkey join r using (n)
union values ('urn:livesIn', '{RDF_TYPE}', '{OWL}InverseFunctionalProperty'), ('urn:by', '{rs.INVERSE_OF}', 'urn:ordered')""")
def owl_same_as(spark, sf):
    """Customers made equal by their nation: classes that grow with the table, each class once and its members beside it."""
    c, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    iri = lambda prefix, k: F.concat(F.lit(prefix), F.col(k).cast("string"))
    t = c.select(iri("urn:c/", "c_custkey").alias("s"), F.lit("urn:livesIn").alias("p"), iri("urn:n/", "c_nationkey").alias("o"))
    t = t.unionByName(orders.select(iri("urn:o/", "o_orderkey").alias("s"), F.lit("urn:by").alias("p"), iri("urn:c/", "o_custkey").alias("o")))
    for s, p, o in (("urn:livesIn", RDF_TYPE, OWL + "InverseFunctionalProperty"), ("urn:by", rs.INVERSE_OF, "urn:ordered")):
        t = t.unionByName(c.agg(F.count("*")).select(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o")))
    facts, members = rs.closure(t)
    equal = members.where("node <> rep").select(F.col("node").alias("s"), F.lit(rs.SAME).alias("p"), F.col("rep").alias("o"))
    return facts.where((F.col("p") != rs.SAME) | (F.col("s") != F.col("o"))).unionByName(equal)


@reg.query("owl_inconsistent", f"""with t as (select distinct 'urn:c/' || c_custkey x, 'urn:g/' || c_mktsegment c from customer union select 'urn:c/' || c_custkey, 'urn:Debtor' from customer where c_acctbal < 0),
line as (select distinct 'urn:p/' || l_partkey s, 'urn:p/' || l_suppkey o from lineitem)
select distinct 'disjoint classes' rule, x subject, 'urn:Debtor' detail from t where c = 'urn:g/MACHINERY' and x in (select x from t where c = 'urn:Debtor')
union select 'irreflexive property', s, 'urn:next' from line where s = o
union select 'asymmetric property', a.s, 'urn:next' from line a join line b on a.s = b.o and a.o = b.s""")
def owl_inconsistent(spark, sf):
    c, line = table(spark, sf, "customer"), table(spark, sf, "lineitem")
    cid = F.concat(F.lit("urn:c/"), "c_custkey").alias("s")
    type_ = F.lit(RDF_TYPE).alias("p")
    t = c.select(cid, type_, F.concat(F.lit("urn:g/"), "c_mktsegment").alias("o"))
    t = t.unionByName(c.where("c_acctbal < 0").select(cid, type_, F.lit("urn:Debtor").alias("o")))
    t = t.unionByName(line.select(F.concat(F.lit("urn:p/"), "l_partkey").alias("s"), F.lit("urn:next").alias("p"), F.concat(F.lit("urn:p/"), "l_suppkey").alias("o")).distinct())
    for s, p, o in (("urn:g/MACHINERY", OWL + "disjointWith", "urn:Debtor"), ("urn:next", RDF_TYPE, OWL + "IrreflexiveProperty"), ("urn:next", RDF_TYPE, OWL + "AsymmetricProperty")):
        t = t.unionByName(c.agg(F.count("*")).select(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o")))
    return rs.inconsistencies(t)


X = "http://www.w3.org/2001/XMLSchema#"
RULES = [
    ("urn:nation", rs.DOMAIN, "urn:Customer"), ("urn:region", rs.DOMAIN, "urn:Customer"), ("urn:unused", rs.DOMAIN, "urn:Customer"),
    ("urn:nation", rs.RANGE, "urn:Place"), ("urn:region", rs.RANGE, "urn:Region"), ("urn:Nation", rs.SUB_CLASS, "urn:Place"),
    ("urn:nationKey", rs.RANGE, X + "integer"), ("urn:segment", rs.RANGE, X + "boolean"), ("urn:source", rs.RANGE, "urn:Code"),
    ("urn:Code", OWL + "onDatatype", X + "string"), ("urn:Code", OWL + "withRestrictions", "_:f"), ("_:f", cs.RDF + "first", "_:f1"),
    ("_:f", cs.RDF + "rest", cs.RDF + "nil"), ("_:f1", X + "pattern", '"[a-m]+"'),
    ("urn:segment", RDF_TYPE, OWL + "FunctionalProperty"), ("urn:segment", RDF_TYPE, OWL + "InverseFunctionalProperty"),
    ("urn:nation", RDF_TYPE, OWL + "AsymmetricProperty"), ("urn:nation", RDF_TYPE, OWL + "IrreflexiveProperty"),
    ("urn:nation", OWL + "propertyDisjointWith", "urn:region"), ("urn:Customer", OWL + "disjointWith", "urn:Place"),
    ("_:d", RDF_TYPE, OWL + "AllDisjointClasses"), ("_:d", OWL + "members", "_:l1"), ("_:l1", cs.RDF + "first", "urn:Nation"), ("_:l1", cs.RDF + "rest", "_:l2"),
    ("_:l2", cs.RDF + "first", "urn:Customer"), ("_:l2", cs.RDF + "rest", "_:l3"), ("_:l3", cs.RDF + "first", "urn:Place"), ("_:l3", cs.RDF + "rest", cs.RDF + "nil"),
    *[t for i, (cls, prop, kind, value) in enumerate([
        ("urn:Customer", "urn:nation", "cardinality", '"1"^^<' + X + "nonNegativeInteger>"), ("urn:Nation", "urn:region", "minCardinality", '"2"'),
        ("urn:Customer", RDFS + "label", "minCardinality", "1"), ("urn:Customer", "urn:source", "maxCardinality", "0"),
        ("urn:Customer", "urn:nation", "allValuesFrom", "urn:Nation"), ("urn:Nation", "urn:region", "someValuesFrom", "urn:Region"),
    ]) for t in ((cls, rs.SUB_CLASS, f"_:r{i}"), (f"_:r{i}", OWL + "onProperty", prop), (f"_:r{i}", OWL + kind, value))],
]

VALID = f"""with t as (select distinct * from ({RML})), ty0 as (select s x, o c from t where p = {TYPE}), ty as (select * from ty0 union select x, 'urn:Place' from ty0 where c = 'urn:Nation'),
n as (select s, p, count(distinct o) n from t group by all)
select 'domain' test, 'urn:nation' target, sum((x is null)::int)::bigint violations, count(*) checked from t left join ty on x = s and c = 'urn:Customer' where p = 'urn:nation'
union all select 'domain', 'urn:region', sum((x is null)::int)::bigint, count(*) from t left join ty on x = s and c = 'urn:Customer' where p = 'urn:region'
union all select 'domain', 'urn:unused', 0, 0
union all select 'range', 'urn:nation', sum((x is null)::int)::bigint, count(*) from t left join ty on x = o and c = 'urn:Place' where p = 'urn:nation'
union all select 'range', 'urn:region', sum((x is null)::int)::bigint, count(*) from t left join ty on x = o and c = 'urn:Region' where p = 'urn:region'
union all select 'datatype', 'urn:nationKey', sum((not regexp_full_match(o, '[+-]?[0-9]+') or datatype <> '{X}integer')::int)::bigint, count(*) from t where p = 'urn:nationKey'
union all select 'datatype', 'urn:segment', sum((o not in ('true', 'false', '0', '1'))::int)::bigint, count(*) from t where p = 'urn:segment'
union all select 'datatype', 'urn:source', 0, count(*) from t where p = 'urn:source'
union all select 'pattern', 'urn:source', sum((not regexp_full_match(o, '[a-m]+'))::int)::bigint, count(*) from t where p = 'urn:source'
union all select 'functional', 'urn:segment', sum((n > 1)::int)::bigint, count(*) from n where p = 'urn:segment'
union all select 'inverse functional', 'urn:segment', sum((k > 1)::int)::bigint, count(*) from (select o, count(distinct s) k from t where p = 'urn:segment' group by 1)
union all select 'asymmetric', 'urn:nation', sum((b.s is not null)::int)::bigint, count(*) from t a left join t b on a.s = b.o and a.o = b.s and b.p = 'urn:nation' where a.p = 'urn:nation'
union all select 'irreflexive', 'urn:nation', sum((s = o)::int)::bigint, count(*) from t where p = 'urn:nation'
union all select 'disjoint properties', 'urn:nation urn:region', sum((b.s is not null)::int)::bigint, count(*) from t a left join t b on a.s = b.s and a.o = b.o and b.p = 'urn:region' where a.p = 'urn:nation'
union all select 'disjoint', 'urn:Customer urn:Place', sum((b.x is not null)::int)::bigint, count(*) from ty a left join ty b on a.x = b.x and b.c = 'urn:Place' where a.c = 'urn:Customer'
union all select 'all disjoint', '_:d', sum((k > 1)::int)::bigint, count(*) from (select x, count(*) k from ty where c in ('urn:Nation', 'urn:Customer', 'urn:Place') group by 1)
union all select u.test, 'urn:Customer urn:nation', sum((case when u.test = 'min cardinality' then coalesce(n, 0) < 1 else coalesce(n, 0) > 1 end)::int)::bigint, count(*)
  from ty left join n on s = x and p = 'urn:nation', (values ('min cardinality'), ('max cardinality')) u(test) where c = 'urn:Customer' group by 1
union all select 'max cardinality', 'urn:Customer urn:source', sum((coalesce(n, 0) > 0)::int)::bigint, count(*) from ty left join n on s = x and p = 'urn:source' where c = 'urn:Customer'
union all select 'min cardinality', 'urn:Nation urn:region', sum((coalesce(n, 0) < 2)::int)::bigint, count(*) from ty left join n on s = x and p = 'urn:region' where c = 'urn:Nation'
union all select 'label', 'urn:Customer', sum((s is null)::int)::bigint, count(*) from ty left join (select distinct s from t where p = {LABEL}) on s = x where c = 'urn:Customer'
union all select 'all values', 'urn:Customer urn:nation urn:Nation', sum((b.x is null)::int)::bigint, count(*) from ty a join t on s = a.x and p = 'urn:nation' left join ty b on b.x = o and b.c = 'urn:Nation' where a.c = 'urn:Customer'
union all select 'some values', 'urn:Nation urn:region urn:Region', count(*), count(*) from ty where c = 'urn:Nation'"""


@reg.query("rdf_validate", VALID)
def rdf_validate(spark, sf):
    return cs.validate(cut(rml_map(spark, sf), "triples"), spark.createDataFrame(RULES, "s string, p string, o string"))


@reg.query("stream_graph", f"""with t as (select 'urn:e/' || event_id s, 'urn:user' p, 'urn:u/' || user_id o, false l from events
 union all select 'urn:e/' || event_id, {TYPE}, 'urn:' || event_type, false from events union all select 'urn:u/' || user_id, {LABEL}, 'user ' || user_id, true from events),
n as (select s id, case when p = {TYPE} then o end c, case when p = {LABEL} then o end l from t union all select o, null, null from t where p = 'urn:user')
select id, false literal, null::varchar "value", max(c) class_uri, max(l) "label" from n group by 1""")
def stream_graph(spark, sf):
    e = table(spark, sf, "events")
    event, user = F.concat(F.lit("urn:e/"), "event_id"), F.concat(F.lit("urn:u/"), "user_id")
    tr = lambda s, p, o, lit: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(lit).alias("o_is_literal"))
    rows = F.array(
        tr(event, "urn:user", user, False), tr(event, RDF_TYPE, F.concat(F.lit("urn:"), "event_type"), False),
        tr(user, RDFS + "label", F.concat(F.lit("user "), "user_id"), True),
    )
    source, target, ckpt = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-ckpt"))
    e.select(F.explode(rows).alias("t")).select("t.*").repartition(3, "s").write.parquet(source)
    query = st.stream_graph(spark, source, target, ckpt)
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return st.current_nodes(spark, target)
