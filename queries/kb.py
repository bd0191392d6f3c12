"""Knowledge-base alignment over two triple views of the business tables.

KB a holds regions, nations, customers and suppliers. KB b has the same things under other
names, its labels in upper case, but only the customers that have placed an order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, r6, table
from tripleweave.operators import kb_align as kb
from tripleweave.operators import prob_align as pa
from tripleweave.plans.rounds import cut, new_path
from tripleweave.sources import records as rd

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


def triples(spark, sf, side: str):
    up = side == "b"
    label = (lambda c: F.upper(c)) if up else (lambda c: F.col(c))
    names = {"name": "label", "inRegion": "partOf", "inNation": "locatedIn", "segment": "market"}
    pred = lambda n: f"urn:{side}:{names[n] if up else n}"
    iri = lambda kind, c: F.concat(F.lit(f"urn:{side}:{kind}/"), F.col(c).cast("string"))
    out = []

    def add(df, subject, rows):
        facts = F.array(*[
            F.struct(subject.alias("s"), F.lit(pred(p)).alias("p"), o.alias("o"), F.lit(lit).alias("o_is_literal")) for p, o, lit in rows
        ])
        out.append(df.select(F.explode(facts).alias("t")).select("t.*"))

    add(table(spark, sf, "region"), iri("r", "r_regionkey"), [("name", label("r_name"), True)])
    add(table(spark, sf, "nation"), iri("n", "n_nationkey"), [("name", label("n_name"), True), ("inRegion", iri("r", "n_regionkey"), False)])
    customer = table(spark, sf, "customer")
    if up:
        customer = customer.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")
    add(customer, iri("c", "c_custkey"), [
        ("name", label("c_name"), True), ("segment", label("c_mktsegment"), True), ("inNation", iri("n", "c_nationkey"), False),
    ])
    add(table(spark, sf, "supplier"), iri("s", "s_suppkey"), [("name", label("s_name"), True), ("inNation", iri("n", "s_nationkey"), False)])
    all_ = out[0]
    for part in out[1:]:
        all_ = all_.unionByName(part)
    return all_


def facts(spark, sf, side):
    return kb.load_facts(triples(spark, sf, side))


def _sql_kb(side: str) -> str:
    up = side == "b"
    t = (lambda c: f"'\"' || upper({c}) || '\"'") if up else (lambda c: f"'\"' || {c} || '\"'")
    names = {"name": "label", "inRegion": "partOf", "inNation": "locatedIn", "segment": "market"}
    p = lambda n: f"'urn:{side}:{names[n] if up else n}'"
    who = "(select * from customer where c_custkey in (select o_custkey from orders))" if up else "customer"
    d = f"""select 'urn:{side}:r/' || r_regionkey s, {p('name')} p, {t('r_name')} o from region
    union all select 'urn:{side}:n/' || n_nationkey, {p('name')}, {t('n_name')} from nation
    union all select 'urn:{side}:n/' || n_nationkey, {p('inRegion')}, 'urn:{side}:r/' || n_regionkey from nation
    union all select 'urn:{side}:c/' || c_custkey, {p('name')}, {t('c_name')} from {who}
    union all select 'urn:{side}:c/' || c_custkey, {p('segment')}, {t('c_mktsegment')} from {who}
    union all select 'urn:{side}:c/' || c_custkey, {p('inNation')}, 'urn:{side}:n/' || c_nationkey from {who}
    union all select 'urn:{side}:s/' || s_suppkey, {p('name')}, {t('s_name')} from supplier
    union all select 'urn:{side}:s/' || s_suppkey, {p('inNation')}, 'urn:{side}:n/' || s_nationkey from supplier"""
    i = "1" if side == "a" else "2"
    return f"d{i} as ({d}), f{i} as (select s, p, o from d{i} union all select o, p || '^-1', s from d{i})"


INV = "case when ends_with(p, '^-1') then left(p, length(p) - 3) else p || '^-1' end"
KB1, KB2 = _sql_kb("a"), _sql_kb("b")
KBS = f"{KB1}, {KB2}"
FUN = """g1 as (select p, count(distinct s) / count(*)::double score from f1 group by 1), g2 as (select p, count(distinct s) / count(*)::double score from f2 group by 1),
fun as (select p, least(g1.score, g2.score) score from g1 full join g2 using (p))"""
# Seeds: the regions, plus the literals that are equal up to case.
SEEDS = """sc as (select 'urn:a:r/' || r_regionkey e1, 'urn:b:r/' || r_regionkey e2, 1.0::double score from region
union all select distinct a.o, b.o, 1.0::double from d1 a join d2 b on a.o like '"%' and b.o like '"%' and upper(a.o) = b.o)"""


def sql_bilateral(src: str, out: str) -> str:
    return f"""{out}_l as (select * from {src} qualify score = max(score) over (partition by e1)),
    {out}_r as (select * from {out}_l qualify score = max(score) over (partition by e2)),
    {out}_own as (select e1 from {out}_r where e1 = e2),
    {out}_f as (select * from {out}_r where e1 <> e2 and e2 not in (select e1 from {out}_own)),
    {out} as (select e1, e2, max(score) score from (select e1, e2, score from {out}_f union all select e2, e1, score from {out}_f) where e1 not in (select e1 from {out}_own) group by all
      union all select e1, e2, score from {out}_r where e1 = e2)"""


SUB = """ps as (select p1, p2, (case when p1 = p2 then 1 else 0.1 end)::double score from (select distinct p p1 from f1), (select distinct p p2 from f2)),
sub as (select distinct * from (select p1, p2, score from ps union all select p2, p1, score from ps))"""


def seeds(spark, sf, f1, f2):
    regions = table(spark, sf, "region").select(
        F.concat(F.lit("urn:a:r/"), "r_regionkey").alias("e1"), F.concat(F.lit("urn:b:r/"), "r_regionkey").alias("e2"), F.lit(1.0).alias("score")
    )
    l1 = f1.where(kb.is_literal("o")).select(F.col("o").alias("e1")).distinct()
    l2 = f2.where(kb.is_literal("o")).select(F.col("o").alias("e2")).distinct()
    return regions.unionByName(l1.join(l2, F.upper("e1") == F.col("e2")).select("e1", "e2", F.lit(1.0).alias("score")))


def scored(df):
    return df.withColumn("score", r6("score"))


@reg.query("kg_load", f"with {KB1} select s, p, o from f1")
def kg_load(spark, sf):
    """Relation and attribute triples through tab-separated files."""
    t = triples(spark, sf, "a")
    rel, att = new_path(spark, "rel"), new_path(spark, "attr")
    line = F.concat_ws("\t", "s", "p", "o").alias("value")
    t.where("NOT o_is_literal").select(line).write.text(rel)
    t.where("o_is_literal").select(line).write.text(att)
    return kb.load_facts(rd.read_relation_files(spark, rel, att))


@reg.query("kg_functionality", f"with {KB1} select p, round(count(distinct s) / count(*)::double, 6) score from f1 group by 1")
def kg_functionality(spark, sf):
    return scored(kb.functionality(facts(spark, sf, "a")))


def sql_fun2(i: int) -> str:
    return f"""v{i} as (select s, {INV} p, o from f{i}),
    w{i} as (select least(a.p, b.p) p1, greatest(a.p, b.p) p2, least(a.o, b.o) lo, greatest(a.o, b.o) hi from v{i} a join v{i} b on a.s = b.s and (a.p, a.o) < (b.p, b.o)),
    fun2_{i} as (select p1, p2, count(distinct (lo, hi)) / count(*)::double score from w{i} group by all)"""


@reg.query("kg_functionality2", f"with {KB1}, {sql_fun2(1)} select p1, p2, round(score, 6) score from fun2_1")
def kg_functionality2(spark, sf):
    return scored(kb.functionality_pairs(cut(facts(spark, sf, "a"), "facts")))


@reg.query("kg_functionality_set", f"""with {KB1}, t as (select n.o a, m.o b, r.o c from f1 n join f1 m on n.s = m.s join f1 r on r.s = n.s
 where n.p = 'urn:a:inNation' and m.p = 'urn:a:name' and r.p = 'urn:a:segment')
select round(count(distinct (a, b, c)) / count(*)::double, 6) score from t""")
def kg_functionality_set(spark, sf):
    return scored(kb.functionality_of(facts(spark, sf, "a"), [f"urn:a:{p}^-1" for p in ("inNation", "name", "segment")]))


@reg.query("kg_merge_functionality", f"with {KBS}, {FUN} select p, round(score, 6) score from fun")
def kg_merge_functionality(spark, sf):
    return scored(kb.merge_functionality(kb.functionality(facts(spark, sf, "a")), kb.functionality(facts(spark, sf, "b")), ["p"]))


@reg.query("kg_local_functionality", f"with {KB1} select s, p, round(1 / count(*)::double, 6) score from f1 group by all")
def kg_local_functionality(spark, sf):
    return scored(kb.local_functionality(facts(spark, sf, "a")))


@reg.query("kg_joint_functionality", f"""with {KB1}, k as (select s c, max(case when p = 'urn:a:inNation' then o end) n, max(case when p = 'urn:a:segment' then o end) g from d1 where s like 'urn:a:c/%' group by 1)
select c set_id, round(1 / count(*) over (partition by n, g)::double, 6) score from k""")
def kg_joint_functionality(spark, sf):
    """How many customers share both nation and segment with a customer."""
    f = cut(facts(spark, sf, "a"), "facts")
    own = f.where(F.col("s").startswith("urn:a:c/") & F.col("p").isin("urn:a:inNation", "urn:a:segment"))
    return scored(kb.joint_local_functionality(f, own.select(F.col("s").alias("set_id"), F.col("o").alias("s"), kb.invert(F.col("p")).alias("p"))))


@reg.query("kg_init_subsumption", f"with {KBS}, {SUB} select p1, p2, score from sub")
def kg_init_subsumption(spark, sf):
    return kb.init_subsumption(facts(spark, sf, "a"), facts(spark, sf, "b"))


@reg.query("kg_merge_subsumption", f"""with {KBS}, {SUB}, n as (select p p1, replace(p, 'urn:a:', 'urn:b:') p2, count(distinct s) / count(*)::double score from f1 group by 1)
select p1, p2, round(max(score), 6) score from (select * from sub union all select * from n) group by all""")
def kg_merge_subsumption(spark, sf):
    f1, f2 = facts(spark, sf, "a"), facts(spark, sf, "b")
    new = kb.functionality(f1).select(F.col("p").alias("p1"), F.replace(F.col("p"), F.lit("urn:a:"), F.lit("urn:b:")).alias("p2"), "score")
    return scored(kb.merge_subsumption(kb.init_subsumption(f1, f2), new))


def both(spark, sf):
    f1, f2 = cut(facts(spark, sf, "a"), "facts"), cut(facts(spark, sf, "b"), "facts")
    return f1, f2, seeds(spark, sf, f1, f2)


@reg.query("kg_bilateral_max", f"""with {KBS}, t as (select a.s e1, b.s e2, count(*) / 4.0::double score from d1 a join d2 b on upper(a.o) = b.o and a.o like '"%' group by all), {sql_bilateral('t', 'm')}
select e1, e2, score from m""")
def kg_bilateral_max(spark, sf):
    """Entities scored by the number of literals they share."""
    f1, f2, _ = both(spark, sf)
    lit = lambda f: f.where(kb.is_literal("o"))
    shared = kb.shared_objects(lit(f1).select(F.col("s").alias("e1"), F.upper("o").alias("o")), lit(f2).select(F.col("s").alias("e2"), "o"), dominated=False)
    return kb.bilateral_max(shared.select("e1", "e2", (F.col("n") / 4.0).alias("score")))


BOOT = f"""{sql_bilateral('sc', 'm0')}, {FUN}, {SUB},
lf1 as (select s, p, 1 / count(*)::double l from f1 group by all), lf2 as (select s, p, 1 / count(*)::double l from f2 group by all),
hop as (select a.o e1, b.o e2, max(least(m0.score, x.l, y.l, u.score, v.score, greatest(sa.score, sb.score), 1.0)) score
  from f1 a join m0 on m0.e1 = a.s join f2 b on b.s = m0.e2 join lf1 x on x.s = a.s and x.p = a.p join lf2 y on y.s = b.s and y.p = b.p
  join fun u on u.p = a.p join fun v on v.p = b.p join sub sa on sa.p1 = a.p and sa.p2 = b.p join sub sb on sb.p1 = b.p and sb.p2 = a.p
  where a.o not like '"%' and b.o not like '"%' group by all),
boot as (select e1, e2, max(score) score from (select * from sc union all select * from hop) group by all)"""


@reg.query("kg_bootstrap", f"with {KBS}, {SEEDS}, {BOOT}, {sql_bilateral('boot', 'mb')} select e1, e2, round(score, 6) score from mb")
def kg_bootstrap(spark, sf):
    """The matches after one hop; pairs that cannot be matches are never listed."""
    f1, f2, s = both(spark, sf)
    fun = kb.merge_functionality(kb.functionality(f1), kb.functionality(f2), ["p"])
    hop = kb.bootstrap(f1, f2, s, kb.init_subsumption(f1, f2), fun, dominated=False)
    return scored(kb.bilateral_max(cut(hop, "scores")))


def sql_agree(a: str, b: str) -> str:
    return f"""select p p1, p2, least(1.0, sum(m) * 3 / any_value(n)) score from (
      select x.s, x.p, x.o, y.p p2, max(least(ms.score, mo.score)) m from {a} x join m0 ms on ms.e1 = x.s join m0 mo on mo.e1 = x.o
      join {b} y on y.s = ms.e2 and y.o = mo.e2 group by all) join (select p, count(*)::double n from {a} group by 1) using (p) group by all"""


ALSO = """sc2 as (select * from sc union all select 'urn:a:c/' || c_custkey, 'urn:b:c/' || c_custkey, 0.8::double from customer where c_acctbal > 0
 union all select 'urn:a:n/' || n_nationkey, 'urn:b:n/' || n_nationkey, 0.9::double from nation)"""
SUBREL = f"""{ALSO}, {sql_bilateral('sc2', 'm0')}, {SUB}, ag as ({sql_agree('f1', 'f2')} union all {sql_agree('f2', 'f1')}),
sub2 as (select p1, p2, max(score) score from (select * from sub union all select * from ag) group by all)"""


def more_matches(spark, sf, s):
    iri = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cust = table(spark, sf, "customer").where("c_acctbal > 0").select(iri("urn:a:c/", "c_custkey").alias("e1"), iri("urn:b:c/", "c_custkey").alias("e2"), F.lit(0.8).alias("score"))
    nat = table(spark, sf, "nation").select(iri("urn:a:n/", "n_nationkey").alias("e1"), iri("urn:b:n/", "n_nationkey").alias("e2"), F.lit(0.9).alias("score"))
    return s.unionByName(cust).unionByName(nat)


def subrelations(spark, sf):
    f1, f2, s = both(spark, sf)
    matches = cut(kb.bilateral_max(more_matches(spark, sf, s)), "matches")
    return f1, f2, matches, cut(kb.map_subrelations(f1, f2, matches, kb.init_subsumption(f1, f2)), "subsumption")


@reg.query("kg_subrelations", f"with {KBS}, {SEEDS}, {SUBREL} select p1, p2, round(score, 6) score from sub2")
def kg_subrelations(spark, sf):
    return scored(subrelations(spark, sf)[3])


@reg.query("kg_quasi_eq", f"""with {KBS}, {SEEDS}, {SUBREL} select a.p1, a.p2, round(greatest(a.score, b.score), 6) score from sub2 a join sub2 b on a.p1 = b.p2 and a.p2 = b.p1
where a.p1 in (select p from f1) and a.p2 in (select p from f2)""")
def kg_quasi_eq(spark, sf):
    f1, f2, _, sub = subrelations(spark, sf)
    return scored(kb.quasi_equivalence(sub, f1, f2))


def evidence(spark, sf):
    f1, f2, matches, sub = subrelations(spark, sf)
    quasi = cut(kb.quasi_equivalence(sub, f1, f2), "quasi")
    return f1, f2, matches, cut(kb.search_evidence(f1, f2, matches, quasi), "evidence")


@reg.query("kg_evidence")
def kg_evidence(spark, sf):
    return evidence(spark, sf)[3]


@reg.query("kg_select")
def kg_select(spark, sf):
    _, _, matches, found = evidence(spark, sf)
    return kb.select_candidates(found, matches)


@reg.query("kg_rules")
def kg_rules(spark, sf):
    f1, f2, matches, found = evidence(spark, sf)
    fun = kb.merge_functionality(kb.functionality(f1), kb.functionality(f2), ["p"])
    pairs = kb.merge_functionality(kb.functionality_pairs(f1), kb.functionality_pairs(f2), ["p1", "p2"])
    return kb.apply_rules(kb.select_candidates(found, matches), f1, f2, fun, pairs)


@reg.query("kg_guarded_merge", f"""with {KBS}, {SEEDS}, {ALSO}, {sql_bilateral('sc2', 'm0')}, best as (select e1, max(score) b from m0 group by 1),
n as (select 'urn:a:c/' || c_custkey e1, 'urn:b:c/' || c_custkey e2, (c_nationkey / 25.0)::double score from customer),
k as (select n.* from n left join best x on x.e1 = n.e1 left join best y on y.e1 = n.e2 where n.score > coalesce(greatest(x.b, y.b), 0))
select e1, e2, round(max(score), 6) score from (select * from sc2 union all select * from k) group by all having max(score) > 0""")
def kg_guarded_merge(spark, sf):
    f1, f2, s = both(spark, sf)
    scores = more_matches(spark, sf, s)
    new = table(spark, sf, "customer").select(
        F.concat(F.lit("urn:a:c/"), "c_custkey").alias("e1"), F.concat(F.lit("urn:b:c/"), "c_custkey").alias("e2"), (F.col("c_nationkey") / 25.0).alias("score")
    )
    return scored(kb.guarded_merge(scores, new, kb.bilateral_max(scores)))


@reg.query("kg_match_literals", f"""with {KBS}, l1 as (select distinct o, array_to_string(list_filter(string_split_regex(lower(o), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') n from d1 where o like '"%'),
l2 as (select distinct o, array_to_string(list_filter(string_split_regex(lower(o), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') n from d2 where o like '"%'),
h1 as (select o, n, list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) g from l1),
h2 as (select o, n, list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) g from l2),
c as (select h1.o e1, h2.o e2, case when h1.n = h2.n then 1.0 else len(list_intersect(h1.g, h2.g)) / sqrt(len(h1.g) * len(h2.g)) end score from h1, h2)
select e1, e2, round(score, 6) score from c where score >= 0.7""")
def kg_match_literals(spark, sf):
    f1, f2, _ = both(spark, sf)
    return scored(kb.match_literals(f1, f2))


def literal_vectors(spark, sf, facts):
    """A vector for every literal with a number in it, by that number."""
    number = F.regexp_extract("o", "([0-9]+)", 1).try_cast("bigint")
    named = facts.where("o LIKE '\"%'").select("o").distinct().select("o", (number % 500).alias("vec_id"))
    return named.join(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("o", "vec")


@reg.query("kg_match_vectors", f"""with {KBS}, {', '.join(f"""l{i} as (select o, array_to_string(list_filter(string_split_regex(lower(o), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') n from (select distinct o from d{i} where o like '"%')),
v{i} as (select o, embedding::double[] v, sqrt(list_inner_product(embedding::double[], embedding::double[])) z from l{i} join embeddings on vec_id = try_cast(regexp_extract(o, '([0-9]+)', 1) as bigint) % 500)""" for i in (1, 2))},
c as (select a.o e1, b.o e2, 1.0::double score from l1 a join l2 b on (a.n = b.n and a.n <> '') or a.o = b.o
union all select a.o, b.o, list_inner_product(a.v, b.v) / (a.z * b.z) s from v1 a, v2 b where s >= 0.7 - 1e-12)
select e1, e2, round(max(score), 6) score from c group by all""")
def kg_match_vectors(spark, sf):
    f1, f2, _ = both(spark, sf)
    return scored(kb.match_literals(f1, f2, vectors1=literal_vectors(spark, sf, f1), vectors2=literal_vectors(spark, sf, f2)))


@reg.query("kg_align")
def kg_align(spark, sf):
    f1, f2, s = both(spark, sf)
    matches, _ = kb.align_kbs(f1, f2, s, init=0.99, max_iter=5)
    return matches


@reg.query("prob_iteration", f"""with {KBS}, eq as (select distinct a.o e1, b.o e2 from d1 a join d2 b on a.o like '"%' and upper(a.o) = b.o),
i1 as (select p, count(distinct o) / count(*)::double fun from f1 group by 1), i2 as (select p, count(distinct o) / count(*)::double fun from f2 group by 1),
t as (select a.s e1, b.s e2, sum(ln(1 - 0.1 * i1.fun) + ln(1 - 0.1 * i2.fun)) l from f1 a join eq on eq.e1 = a.o join f2 b on b.o = eq.e2 join i1 on i1.p = a.p join i2 on i2.p = b.p group by all)
select e1, e2, round(1 - exp(l), 6) score from t""")
def prob_iteration(spark, sf):
    f1, f2, _ = both(spark, sf)
    return scored(pa.instance_scores(f1, f2, pa.literal_equalities(f1, f2), None))


@reg.query("prob_relations", f"""with {KBS}, eq as (select distinct a.o e1, b.o e2, 1.0::double score from d1 a join d2 b on a.o like '"%' and upper(a.o) = b.o
 union all select 'urn:a:c/' || c_custkey, 'urn:b:c/' || c_custkey, 0.75::double from customer),
m as (select x.s, x.p, x.o, a.e2 s2, b.e2 o2, least(a.score * b.score, 1 - 1e-9) w from f1 x join eq a on a.e1 = x.s join eq b on b.e1 = x.o),
base as (select p, sum(w) b from m group by 1), h as (select m.p, y.p p2, sum(w) w from m join f2 y on y.s = s2 and y.o = o2 group by all)
select h.p p1, p2, round(w / b, 6) score from h join base using (p)""")
def prob_relations(spark, sf):
    f1, f2, _ = both(spark, sf)
    cust = table(spark, sf, "customer").select(F.concat(F.lit("urn:a:c/"), "c_custkey").alias("e1"), F.concat(F.lit("urn:b:c/"), "c_custkey").alias("e2"), F.lit(0.75).alias("score"))
    return scored(pa.relation_scores(f1, f2, pa.literal_equalities(f1, f2).unionByName(cust)))


@reg.query("prob_align")
def prob_align(spark, sf):
    f1, f2, _ = both(spark, sf)
    instances, _ = pa.align_probabilistic(f1, f2, 3)
    return instances


@reg.query("prob_classes", """with m as (select c_custkey k, c_mktsegment g, c_nationkey n from customer where c_custkey in (select o_custkey from orders)),
z as (select g, count(*)::double n from customer c join (select c_mktsegment g, c_custkey k from customer) q on q.k = c.c_custkey group by 1)
select 'urn:g/' || m.g c1, 'urn:n/' || m.n c2, round(count(*) * 0.5 / any_value(z.n), 6) score from m join z on z.g = m.g group by all""")
def prob_classes(spark, sf):
    """Segments of customers as classes of one side, nations of ordering customers of the other."""
    c = table(spark, sf, "customer")
    who = c.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")
    f1 = c.select(F.concat(F.lit("a"), "c_custkey").alias("s"), F.lit("type").alias("p"), F.concat(F.lit("urn:g/"), "c_mktsegment").alias("o"))
    f2 = who.select(F.concat(F.lit("b"), "c_custkey").alias("s"), F.lit("type").alias("p"), F.concat(F.lit("urn:n/"), "c_nationkey").alias("o"))
    equal = who.select(F.concat(F.lit("a"), "c_custkey").alias("e1"), F.concat(F.lit("b"), "c_custkey").alias("e2"), F.lit(0.5).alias("score"))
    return scored(pa.class_scores(f1, f2, equal, "type"))
