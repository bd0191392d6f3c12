"""Iterative alignment of two knowledge bases by fuzzy rules, as joins.

A knowledge base is a set of facts ``(s, p, o)``; literal objects are written in quotes
(``node``), and every fact also stands inverted (``p`` with ``^-1``). Scores are long
tables: matches ``(e1, e2, score)`` and predicate subsumption ``(p1, p2, score)``. Most
steps read their inputs several times: hand them written tables (``plans.rounds.cut``), as
``align_kbs`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import text as tx
from tripleweave.operators.vectors import cosine_links
from tripleweave.plans.rounds import cut, top_per_group

INVERSE = "^-1"
#: Facts that lead to more candidates than this are looked up before they are expanded; the selection stays the same.
HEAVY_DEGREE = 64
#: Rounds after which an alignment that should settle is taken to be stuck.
ROUND_LIMIT = 100


def node(value: Column, is_literal: Column) -> Column:
    """Literals in quotes, so that a text never equals an IRI."""
    return F.when(is_literal, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def is_literal(col: Column | str) -> Column:
    return F.startswith(F.col(col) if isinstance(col, str) else col, F.lit('"'))


def invert(p: Column) -> Column:
    return F.when(F.endswith(p, F.lit(INVERSE)), F.substring(p, F.lit(1), F.length(p) - len(INVERSE))).otherwise(
        F.concat(p, F.lit(INVERSE))
    )


def load_facts(triples: DataFrame) -> DataFrame:
    """Distinct facts and their inverses from ``(s, p, o, o_is_literal)``."""
    direct = triples.select("s", "p", node(F.col("o"), F.col("o_is_literal")).alias("o")).distinct()
    return direct.unionAll(direct.select(F.col("o").alias("s"), invert(F.col("p")).alias("p"), F.col("s").alias("o")))


# --- functionality ---------------------------------------------------------------------


def functionality(facts: DataFrame) -> DataFrame:
    """``(p, score)``: distinct subjects per fact."""
    return facts.groupBy("p").agg((F.count_distinct("s") / F.count("*")).alias("score"))


def functionality_pairs(facts: DataFrame) -> DataFrame:
    """``(p1, p2, score)`` with p1 <= p2: distinct object pairs per pair of facts of a subject.

    The keys are the inverted predicates. The number of fact pairs follows from counts alone.
    A pair of objects can only recur if both objects are reached more than once through the
    two predicates, so only those pairs are listed and counted; all others count once each.
    """
    f = facts.select("s", invert(F.col("p")).alias("p"), "o")
    n = f.groupBy("s", "p").agg(F.count("*").alias("n"))
    a, b = n.select("s", F.col("p").alias("p1"), F.col("n").alias("n1")), n.select("s", F.col("p").alias("p2"), F.col("n").alias("n2"))
    combos = F.when(F.col("p1") == F.col("p2"), F.expr("n1 * (n1 - 1) div 2")).otherwise(F.col("n1") * F.col("n2"))
    total = (
        a.join(b, "s").where("p1 <= p2").withColumn("c", combos).groupBy("p1", "p2")
        .agg(F.sum("c").alias("total")).where("total > 0")
    )

    reached = f.groupBy("o", "p").agg(F.count("*").alias("times"))
    via = f.join(reached, ["o", "p"])
    # Another fact with the same predicate leads to the object: it may recur under any key ...
    preds = n.select("s", F.col("p").alias("q"))
    often = via.where("times > 1").join(preds, "s").select("s", "p", "o", "q")
    # ... or a fact with the other predicate of the key does.
    other = reached.select("o", F.col("p").alias("q"))
    once = via.where("times = 1").join(other, "o").where("p <> q").join(preds, ["s", "q"], "left_semi").select("s", "p", "o", "q")
    shared = often.unionAll(once)
    x = shared.select("s", F.col("p").alias("p1"), F.col("q").alias("p2"), F.col("o").alias("x")).where("p1 <= p2")
    y = shared.select("s", F.col("q").alias("p1"), F.col("p").alias("p2"), F.col("o").alias("y")).where("p1 <= p2")
    pairs = x.join(y, ["s", "p1", "p2"]).where("p1 < p2 OR x < y")
    tuples = pairs.groupBy("p1", "p2", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.count("*").alias("times"))
    repeats = tuples.groupBy("p1", "p2").agg(F.sum(F.col("times") - 1).alias("repeats"))
    return total.join(repeats, ["p1", "p2"], "left").select(
        "p1", "p2", ((F.col("total") - F.coalesce("repeats", F.lit(0))) / F.col("total")).alias("score")
    )


def _choices(n: Column, k: int) -> Column:
    """Ways to take ``k`` of ``n``, as a double."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * F.greatest(n - i, F.lit(0)) / (i + 1)
    return out


def functionality_of(facts: DataFrame, predicates: list[str]) -> DataFrame:
    """One row ``(score)``: the same for one given predicate multiset of any size; 0.0 if no subject has it.

    Tuples of objects are counted, not listed. Their number follows from the counts per subject. For
    the distinct ones, objects reached by exactly the same facts are one class and can stand for one
    another: with as many objects of a class as there are predicates, every kind of tuple occurs, and
    a kind stands for as many tuples as there are ways to fill it from its classes. Two 64-bit sums
    over its facts name a class.
    """
    k = len(predicates)
    f = facts.select("s", invert(F.col("p")).alias("p"), "o").where(F.col("p").isin(*set(predicates)))
    reached = [F.sum(F.xxhash64(*salt, "s", "p").cast("decimal(20,0)")).cast("string") for salt in ([], [F.lit(1)])]
    objects = cut(f.groupBy("o").agg(F.concat_ws(":", *reached).alias("c")), "object_classes")
    sizes = objects.groupBy("c").agg(F.count("*").alias("n"))
    few = top_per_group(objects, ["c"], [F.col("o")], k, ["o"]).join(sizes, "c")
    shown = cut(f.join(few, "o").select("s", "p", F.struct("c", "n", "o").alias("x")), "shown")
    joined, names = None, []
    for i, p in enumerate(sorted(predicates)):
        part = shown.where(F.col("p") == p).select("s", F.col("x").alias(f"x{i}"))
        joined = part if joined is None else joined.join(part, "s")
        if i and sorted(predicates)[i - 1] == p:
            joined = joined.where(F.col(f"x{i - 1}.o") < F.col(f"x{i}.o"))
        names.append(f"x{i}")
    tuples = joined.select(F.array(*names).alias("t"))
    # A kind: per class, how often each of its objects stands in the tuple.
    kinds = tuples.select(F.array_sort(F.transform(F.array_distinct("t"), lambda x: F.struct(
        x["c"].alias("c"), x["n"].alias("n"), F.size(F.filter("t", lambda y: y["o"] == x["o"])).alias("m")
    ))).alias("kind")).distinct()
    earlier = lambda i, same: F.size(F.filter(F.slice("kind", 1, i), same))
    ways = F.transform("kind", lambda e, i: (e["n"] - earlier(i, lambda y: y["c"] == e["c"])) / (
        1 + earlier(i, lambda y: (y["c"] == e["c"]) & (y["m"] == e["m"]))
    ))
    distinct = kinds.agg(F.sum(F.aggregate(ways, F.lit(1.0), lambda acc, w: acc * w)).alias("_d"))
    combos = F.lit(1.0)
    for p in sorted(set(predicates)):
        combos = combos * _choices(F.count(F.when(F.col("p") == p, 1)), predicates.count(p))
    total = f.groupBy("s").agg(combos.alias("_w")).agg(F.sum("_w").alias("_t"))
    both = distinct.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")  # one row each
    return both.select(F.when(F.col("_t") > 0, F.col("_d") / F.col("_t")).otherwise(0.0).alias("score"))


def merge_functionality(f1: DataFrame, f2: DataFrame, keys: list[str]) -> DataFrame:
    """The smaller value where both knowledge bases know the predicate."""
    both = f1.withColumnRenamed("score", "_a").join(f2.withColumnRenamed("score", "_b"), keys, "full")
    return both.select(*keys, F.least("_a", "_b").alias("score"))


def local_functionality(facts: DataFrame) -> DataFrame:
    """``(s, p, score)``: one over the number of objects."""
    return facts.groupBy("s", "p").agg((1.0 / F.count("*")).alias("score"))


def joint_local_functionality(facts: DataFrame, sets: DataFrame) -> DataFrame:
    """``(set_id, score)``: one over the number of objects that all facts of a set lead to.

    ``sets`` is ``(set_id, s, p)``. Only the objects of the least frequent ``(s, p)`` of a set
    are looked up under the other ones; no object list is ever gathered. Sets of equal facts are
    one class, named by two 64-bit sums, of which the least set is looked up.
    """
    sets = sets.select("set_id", "s", "p").where("set_id IS NOT NULL")
    sums = [F.sum(F.xxhash64(*salt, "s", "p").cast("decimal(20,0)")).cast("string") for salt in ([], [F.lit(1)])]
    classes = cut(sets.groupBy("set_id").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("_class")), "set_classes")
    shown = classes.groupBy("_class").agg(F.min("set_id").alias("set_id"))
    sets = sets.join(shown.select("set_id"), "set_id", "left_semi")
    sizes = facts.groupBy("s", "p").agg(F.count("*").alias("_n"))
    sized = sets.join(sizes, ["s", "p"])
    lead = sized.groupBy("set_id").agg(F.min(F.struct("_n", "s", "p")).alias("_l"), F.count("*").alias("_k"))
    members = lead.select("set_id", "_k", F.col("_l.s").alias("s"), F.col("_l.p").alias("p")).join(facts, ["s", "p"]).select("set_id", "_k", "o")
    hits = members.join(sets, "set_id").join(facts, ["s", "p", "o"], "left_semi")
    full = hits.groupBy("set_id", "o", "_k").agg(F.count("*").alias("_h")).where("_h = _k")
    found = full.groupBy("set_id").agg((1.0 / F.count("*")).alias("score"))
    return classes.join(found.join(shown, "set_id").select("_class", "score"), "_class").select("set_id", "score")


# --- predicates ------------------------------------------------------------------------


def init_subsumption(f1: DataFrame, f2: DataFrame, given: DataFrame | None = None, default: float = 0.1) -> DataFrame:
    """Scores of all predicate pairs, both ways: 1 if identical, else given, else default.

    The pairs are those of two schemas: each predicate of one side carries the predicate list
    of the other.
    """
    p1, p2 = f1.select("p").distinct(), f2.select("p").distinct()
    listed = p2.agg(F.collect_set("p").alias("ps")).scalar()
    pairs = p1.select(F.col("p").alias("p1"), listed.alias("_ps")).select("p1", F.explode("_ps").alias("p2"))
    if given is None:
        known = pairs.withColumn("_g", F.lit(None).cast("double"))
    else:
        either = given.select("p1", "p2", "score").unionAll(given.select("p2", "p1", "score"))
        best = either.groupBy("p1", "p2").agg(F.max("score").alias("_g"))
        known = pairs.join(best, ["p1", "p2"], "left")
    scored = known.select(
        "p1", "p2", F.when(F.col("p1") == F.col("p2"), 1.0).otherwise(F.coalesce("_g", F.lit(default))).alias("score")
    )
    return scored.unionAll(scored.select("p2", "p1", "score")).distinct()


def merge_subsumption(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new score replaces an old one only if it is larger."""
    return old.select("p1", "p2", "score").unionAll(new.select("p1", "p2", "score")).groupBy("p1", "p2").agg(F.max("score").alias("score"))


def _agreement(f1: DataFrame, f2: DataFrame, matches: DataFrame, alpha: float) -> DataFrame:
    """Share of the facts of p1 for which an agreeing fact with p2 exists, times alpha."""
    ms = matches.select(F.col("e1").alias("s"), F.col("e2").alias("s2"), F.col("score").alias("ms"))
    mo = matches.select(F.col("e1").alias("o"), F.col("e2").alias("o2"), F.col("score").alias("mo"))
    # Both ends are mapped before the other facts are met, so the join is on whole facts.
    mapped = f1.join(ms, "s").join(mo, "o")
    other = f2.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
    best = mapped.join(other, ["s2", "o2"]).groupBy("s", "p", "o", "p2").agg(F.max(F.least("ms", "mo")).alias("m"))
    size = f1.groupBy("p").agg(F.count("*").alias("n"))
    return best.groupBy("p", "p2").agg(F.sum("m").alias("m")).join(size, "p").select(
        F.col("p").alias("p1"), "p2", F.least(F.lit(1.0), F.col("m") * alpha / F.col("n")).alias("score")
    )


def map_subrelations(f1: DataFrame, f2: DataFrame, matches: DataFrame, previous: DataFrame, alpha: float = 3.0) -> DataFrame:
    """Subsumption from agreeing facts, in both directions, merged into the previous scores."""
    forward, backward = _agreement(f1, f2, matches, alpha), _agreement(f2, f1, matches, alpha)
    return merge_subsumption(previous, forward.unionAll(backward))


def quasi_equivalence(subsumption: DataFrame, f1: DataFrame, f2: DataFrame) -> DataFrame:
    """``(p1, p2, score)`` from KB 1 to KB 2: the better of both directions."""
    either = subsumption.unionAll(subsumption.select("p2", "p1", "score"))
    best = either.groupBy("p1", "p2").agg(F.max("score").alias("score"))
    in_1 = f1.select(F.col("p").alias("p1")).distinct()
    in_2 = f2.select(F.col("p").alias("p2")).distinct()
    return best.join(in_1, "p1", "left_semi").join(in_2, "p2", "left_semi")


# --- matches ---------------------------------------------------------------------------


def bilateral_max(scores: DataFrame) -> DataFrame:
    """Mutual best matches, all ties kept, in both directions."""
    best_1 = scores.groupBy("e1").agg(F.max("score").alias("_b"))
    left = scores.join(best_1, "e1").where("score = _b").select("e1", "e2", "score")
    best_2 = left.groupBy("e2").agg(F.max("score").alias("_b"))
    mutual = left.join(best_2, "e2").where("score = _b").select("e1", "e2", "score")
    own = mutual.where("e1 = e2").select("e1")
    # An entity matched to itself keeps only that.
    free = mutual.where("e1 <> e2").join(own.select(F.col("e1").alias("e2")), "e2", "left_anti").select("e1", "e2", "score")
    both = free.unionAll(free.select("e2", "e1", "score")).join(own, "e1", "left_anti")
    return both.unionAll(mutual.where("e1 = e2")).groupBy("e1", "e2").agg(F.max("score").alias("score"))


def shared_objects(a: DataFrame, b: DataFrame, dominated: bool = True, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """``(e1, e2, n)``: pairs of rows ``(e1, o)`` and ``(e2, o)`` with one object, counted.

    Without ``dominated`` only mutual best matches are listed, those that ``bilateral_max`` keeps. Pairs are then listed by objects that
    ``heavy_degree`` entities of one side have at most. Entities with the same heavy objects are a class, and what two entities share
    in heavy objects follows from their classes; pairs with nothing else in common are listed only where that is the best of both.
    """
    if dominated:
        return a.join(b, "o").groupBy("e1", "e2").agg(F.count("*").alias("n"))
    # In a struct a null entity is a value like others.
    sides = [d.where("o IS NOT NULL").groupBy(F.struct(e).alias(e), "o").agg(F.count("*").alias(f"c{i}")) for i, (d, e) in enumerate(((a, "e1"), (b, "e2")), 1)]
    sides = [cut(d, "objects") for d in sides]
    degrees = [d.groupBy("o").agg(F.count("*").alias(f"d{i}")) for i, d in enumerate(sides, 1)]
    kinds = cut(degrees[0].join(degrees[1], "o").select("o", (F.least("d1", "d2") > heavy_degree).alias("_heavy")), "kinds")
    sides = [d.join(kinds, "o") for d in sides]
    light = [d.where("NOT _heavy").drop("_heavy") for d in sides]
    light = light[0].join(light[1], "o").groupBy("e1", "e2").agg(F.sum(F.col("c1") * F.col("c2")).alias("l"))
    of, classes = [], []
    for i, d in enumerate(sides, 1):
        own = d.where("_heavy").groupBy(f"e{i}").agg(F.array_sort(F.collect_list(F.struct("o", f"c{i}"))).alias("held"))
        named = cut(own.select("held").distinct().withColumn(f"k{i}", F.monotonically_increasing_id()), "classes")
        of.append(cut(own.join(named, "held").select(f"e{i}", f"k{i}"), "class_of"))
        classes.append(named.select(f"k{i}", F.explode("held").alias("x")).select(f"k{i}", "x.o", f"x.c{i}"))
    both = cut(classes[0].join(classes[1], "o").groupBy("k1", "k2").agg(F.sum(F.col("c1") * F.col("c2")).alias("w")), "class_pairs")
    listed = light.join(of[0], "e1", "left").join(of[1], "e2", "left").join(both, ["k1", "k2"], "left")
    listed = cut(listed.select("e1", "e2", (F.col("l") + F.coalesce("w", F.lit(0))).alias("n")), "listed")

    reach = of[0].join(both.groupBy("k1").agg(F.max("w").alias("n")), "k1").select("e1", "n")
    best_1 = cut(listed.select("e1", "n").unionAll(reach).groupBy("e1").agg(F.max("n").alias("m")), "best")
    left = cut(listed.join(best_1, "e1").where("n = m").select("e1", "e2", "n"), "left")
    # A pair that shares light objects as well has more than its classes, so what is open here is not listed.
    open_1 = of[0].join(best_1, "e1")
    met = cut(open_1.select("k1", "m").distinct().join(both, "k1").where("w = m").select("k1", "k2", "w"), "met")
    reach = of[1].join(met.groupBy("k2").agg(F.max("w").alias("n")), "k2").select("e2", "n")
    best_2 = cut(left.select("e2", "n").unionAll(reach).groupBy("e2").agg(F.max("n").alias("m")), "best")
    known = left.join(best_2, "e2").where("n = m").select("e1", "e2", "n")
    open_2 = of[1].join(best_2, "e2").select("e2", "k2", F.col("m").alias("w"))
    rest = open_1.withColumnRenamed("m", "w").join(met, ["k1", "w"]).join(open_2, ["k2", "w"]).select("e1", "e2", F.col("w").alias("n"))
    return known.unionAll(rest).select(F.col("e1.e1").alias("e1"), F.col("e2.e2").alias("e2"), "n")


def max_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    rows = old.select("e1", "e2", "score").unionAll(new.select("e1", "e2", "score"))
    return rows.groupBy("e1", "e2").agg(F.max("score").alias("score")).where("score > 0")


def bootstrap(
    f1: DataFrame, f2: DataFrame, scores: DataFrame, subsumption: DataFrame, functionalities: DataFrame, dominated: bool = True
) -> DataFrame:
    """One hop from the matched subjects to their objects, merged into ``scores``.

    All objects of a subject and predicate get the same score, so the score is worked out once
    per pair of (subject, predicate) groups. Without ``dominated`` a pair is listed only if it
    reaches the best score of its left entity: that best score never falls, so a weaker pair
    cannot be a mutual best match in this or any later round. Big groups whose members are
    better matched elsewhere then list nothing.
    """
    matched = bilateral_max(scores)
    groups = lambda f, i: (
        local_functionality(f).withColumnRenamed("score", "_l").join(functionalities.withColumnRenamed("score", "_f"), "p")
        .select(F.col("s").alias(f"s{i}"), F.col("p").alias(f"p{i}"), F.least("_l", "_f").alias(f"w{i}"))
    )
    members = lambda f, i: f.where(~is_literal("o")).select(
        F.col("s").alias(f"s{i}"), F.col("p").alias(f"p{i}"), F.col("o").alias(f"e{i}")
    )
    either = subsumption.unionAll(subsumption.select("p2", "p1", "score"))
    implied = either.groupBy("p1", "p2").agg(F.max("score").alias("_s"))
    met = (
        groups(f1, 1).join(matched.select(F.col("e1").alias("s1"), F.col("e2").alias("s2"), F.col("score").alias("_m")), "s1")
        .join(groups(f2, 2), "s2").join(implied, ["p1", "p2"])
        .select("s1", "p1", "s2", "p2", F.least(F.lit(1.0), "_m", "w1", "w2", "_s").alias("score"))
    )
    left, right = members(f1, 1), members(f2, 2)
    if not dominated:
        met = cut(met, "groups")
        reach_1 = met.groupBy("s1", "p1").agg(F.max("score").alias("score")).join(left, ["s1", "p1"]).select("e1", "score")
        best_1 = reach_1.unionAll(scores.select("e1", "score")).groupBy("e1").agg(F.max("score").alias("_b1"))
        left = left.join(best_1, "e1")
        tops = left.select("s1", "p1", "_b1").distinct()
        met = met.join(tops, ["s1", "p1"]).where("score = _b1").select("s1", "p1", "s2", "p2", "score")
    new = met.join(left, ["s1", "p1"]).join(right, ["s2", "p2"])
    if not dominated:
        new = new.where("score = _b1")
    return max_merge(scores, new.groupBy("e1", "e2").agg(F.max("score").alias("score")))


def _certain(matches: DataFrame) -> DataFrame:
    best = matches.groupBy("e1").agg(F.max("score").alias("_b"))
    return best.where(F.round("_b", 1) >= 1.0).select(F.col("e1").alias("s"))


def _settled(found: DataFrame) -> DataFrame:
    """One fact of KB 2 per (fact of KB 1, candidate), then one fact of KB 1 per fact of KB 2."""
    per_candidate = found.groupBy("s1", "q1", "o1", "rank", "s2").agg(
        F.min(F.struct((-F.col("q")).alias("_q"), "o2", "q2", "m", "q")).alias("_e")
    ).select("s1", "s2", "q1", "o1", "rank", "_e.o2", "_e.q2", "_e.m", "_e.q")
    single = per_candidate.groupBy("s1", "s2", "o2", "q2").agg(
        F.min(F.struct((-F.least("m", "q")).alias("_w"), "rank", "q1", "o1", "m", "q")).alias("_e")
    )
    return single.select("s1", "s2", "_e.o1", "_e.q1", "o2", "q2", "_e.m", "_e.q", "_e.rank")


def search_evidence(
    f1: DataFrame, f2: DataFrame, matches: DataFrame, quasi: DataFrame, gram_n: int | None = None, heavy_degree: int | None = None
) -> DataFrame:
    """Pairs of agreeing facts ``(o1, q1, s1)`` and ``(o2, q2, s2)`` per candidate pair.

    An entity of KB 1 uses all its facts, ranked by ``least(object match, predicate match)``, or
    the first ``gram_n`` if a caller says so; per fact a candidate counts once.

    With ``heavy_degree`` the table holds what ``select_candidates`` needs, but not every pair.
    Facts that lead to more than ``heavy_degree`` candidates are not expanded at first: the
    candidates come from the other facts and the heavy ones are only looked up for them. A
    candidate with heavy evidence alone has at most as many pieces of it as the entity has
    heavy facts; where the best candidate found has more, those cannot be selected and stay
    out. For all other entities the heavy facts are expanded as well. ``None`` expands all.
    """
    best_o = matches.groupBy(F.col("e1").alias("o1")).agg(F.max("score").alias("_mo"))
    best_q = quasi.groupBy(F.col("p1").alias("q1")).agg(F.max("score").alias("_mq")).where("_mq > 0")
    facts = (
        f1.select(F.col("s").alias("o1"), F.col("p").alias("q1"), F.col("o").alias("s1"))
        .where(~is_literal("s1")).join(_certain(matches).withColumnRenamed("s", "s1"), "s1", "left_anti")
        .join(best_o, "o1").join(best_q, "q1")
    )
    order = Window.partitionBy("s1").orderBy(F.desc(F.least("_mo", "_mq")), "q1", "o1")
    used = facts.withColumn("rank", F.row_number().over(order)).select("o1", "q1", "s1", "rank")
    used = cut(used if gram_n is None else used.where(F.col("rank") <= gram_n), "used")

    # Which facts of KB 2 a fact may go with depends on their subject and predicate only.
    m = matches.select(F.col("e1").alias("o1"), F.col("e2").alias("o2"), F.col("score").alias("m"))
    other = f2.select(F.col("s").alias("o2"), F.col("p").alias("q2"), F.col("o").alias("s2")).where(~is_literal("s2"))
    heads = other.groupBy("o2", "q2").agg(F.count("*").alias("degree"))
    q = quasi.where("score > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("score").alias("q"))
    met = used.select("o1", "q1").distinct().join(m, "o1").join(heads, "o2").join(q, ["q1", "q2"])
    top = met.groupBy("q1", "o1", "o2").agg(F.max("q").alias("q"))
    aligned = met.join(top, ["q1", "o1", "o2", "q"])
    if heavy_degree is None:
        return _settled(used.join(aligned, ["o1", "q1"]).join(other, ["o2", "q2"]))

    aligned = cut(aligned, "aligned")
    light = cut(used.join(aligned.where(F.col("degree") <= heavy_degree), ["o1", "q1"]).join(other, ["o2", "q2"]), "light")
    heavy = used.join(aligned.where(F.col("degree") > heavy_degree), ["o1", "q1"])
    pairs = light.select("s1", "s2").distinct()
    looked_up = heavy.join(pairs, "s1").join(other, ["o2", "q2", "s2"], "left_semi")
    known = cut(_settled(light.unionByName(looked_up.select(*light.columns))), "known")
    free = known.join(_certain(matches).withColumnRenamed("s", "s2"), "s2", "left_anti")
    reached = free.groupBy("s1", "s2").agg(F.count("*").alias("n")).groupBy("s1").agg(F.max("n").alias("n"))
    limit = heavy.select("s1", "q1", "o1").distinct().groupBy("s1").agg(F.count("*").alias("h"))
    unsure = cut(limit.join(reached, "s1", "left").where("n IS NULL OR n <= h").select("s1"), "unsure")
    rest = light.join(unsure, "s1", "left_semi").unionByName(
        heavy.join(unsure, "s1", "left_semi").join(other, ["o2", "q2"]).select(*light.columns)
    )
    return known.join(unsure, "s1", "left_anti").unionByName(_settled(rest))


def select_candidates(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """The evidence of the candidates with most distinct evidences; certain ones are left out."""
    free = evidence.join(_certain(matches).withColumnRenamed("s", "s2"), "s2", "left_anti")
    counts = free.groupBy("s1", "s2").agg(F.count("*").alias("n"))
    most = counts.groupBy("s1").agg(F.max("n").alias("n"))
    kept = counts.join(most, ["s1", "n"]).select("s1", "s2", F.col("n").alias("max_n"))
    return free.join(kept, ["s1", "s2"])


def _prefix_functionality(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """``(seq, n, score)``: the joint local functionality of the first ``n`` facts of every list, for all ``n`` at once.

    ``rows`` is ``(seq, n, s, p)`` with ``n`` from 1. A list is cut where the least number of objects
    of its facts so far falls to a lower power of two: at most once per bit of a hub's degree. A
    section takes the objects of its first fact and finds the first fact that each does not lead to;
    an object counts for all prefixes before that one. A section of the first fact alone is a count.
    """
    sizes = facts.groupBy("s", "p").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy("seq").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    listed = cut(rows.join(sizes, ["s", "p"]).withColumn("_level", F.floor(F.log2(F.min("_n").over(so_far)))), "prefix_facts")
    sections = listed.groupBy("seq", "_level").agg(F.min(F.struct("n", "s", "p", "_n")).alias("_l"), F.max("n").alias("_to"))
    alone = sections.where("_to = 1").select("seq", F.lit(1).alias("n"), (1.0 / F.col("_l._n")).alias("score"))

    members = (
        sections.where("_to > 1").select("seq", "_level", F.col("_l.n").alias("_from"), "_to", F.col("_l.s").alias("s"), F.col("_l.p").alias("p"))
        .join(facts, ["s", "p"]).select("seq", "_level", "_from", "_to", "o")
    )
    known = facts.withColumn("_there", F.lit(True))
    asked = members.join(listed.select("seq", "n", "s", "p"), "seq").where("n <= _to").join(known, ["s", "p", "o"], "left")
    missed = F.min(F.when(F.col("_there").isNull(), F.col("n")))
    lasts = asked.groupBy("seq", "_level", "_from", "_to", "o").agg((F.coalesce(missed, F.col("_to") + 1) - 1).alias("n")).where("n >= _from")
    ends = lasts.groupBy("seq", "_level", "n").agg(F.count("*").alias("_c"))
    later = Window.partitionBy("seq", "_level").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    # every list of evidence has an object that all its facts lead to: the entity itself
    counted = listed.select("seq", "_level", "n").join(sections.where("_to > 1").select("seq", "_level"), ["seq", "_level"], "left_semi")
    total = F.sum(F.coalesce("_c", F.lit(0))).over(later)
    return alone.unionByName(
        counted.join(ends, ["seq", "_level", "n"], "left").withColumn("_t", total).where("_t > 0").select("seq", "n", (1.0 / F.col("_t")).alias("score"))
    )


def apply_rules(
    selected: DataFrame, f1: DataFrame, f2: DataFrame, functionalities: DataFrame, pair_functionalities: DataFrame, max_prefix: int | None = None
) -> DataFrame:
    """``(e1, e2, score)``: the best score over the prefixes of a candidate's evidence list.

    A prefix counts if both sides repeat objects in the same pattern; its score is the least
    of the harmonic means of object and predicate matches, the joint local functionality on
    both sides, and the functionality of its one or two predicates (1 beyond that). Lists stay
    rows: one row per piece of evidence, with running sums for the prefix that ends in it.
    """
    pair = Window.partitionBy("s1", "s2")
    order = [F.desc(F.least("m", "q")), "rank", "o2", "q2", "o1", "q1", "m", "q"]
    ranked = selected.withColumn("n", F.row_number().over(pair.orderBy(*order))).where("n <= max_n")
    if max_prefix is not None:
        ranked = ranked.where(F.col("n") <= max_prefix)
    # Patterns agree as long as every object stood first at the same place as its partner.
    for i in (1, 2):
        ranked = ranked.withColumn(f"_first{i}", F.min("n").over(Window.partitionBy("s1", "s2", f"o{i}")))
    ranked = ranked.withColumn("_stop", F.min(F.when(F.col("_first1") != F.col("_first2"), F.col("n"))).over(pair))
    so_far = pair.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    valid = ranked.where("_stop IS NULL OR n < _stop")
    for name in ("m", "q"):
        valid = valid.withColumn(f"h{name}", F.col("n") / F.sum(1.0 / F.col(name)).over(so_far))
    for i in (1, 2):
        # Equal lists of one side are looked up once; two 64-bit sums name a list.
        parts = [F.sum(F.xxhash64(*k, "n", f"o{i}", f"q{i}").cast("decimal(20,0)")).over(pair).cast("string") for k in ([], [F.lit(1)])]
        valid = valid.withColumn(f"seq{i}", F.concat_ws(":", *parts)).withColumn(f"_before{i}", F.lag(f"q{i}").over(pair.orderBy("n")))
    valid = cut(valid.select("s1", "s2", "n", "hm", "hq", "o1", "q1", "o2", "q2", "seq1", "seq2", "_before1", "_before2"), "prefixes")
    out = valid
    for i, facts in ((1, f1), (2, f2)):
        lists = valid.select(F.col(f"seq{i}").alias("seq"), "n", F.col(f"o{i}").alias("s"), F.col(f"q{i}").alias("p")).distinct()
        local = _prefix_functionality(facts, lists).select(F.col("seq").alias(f"seq{i}"), "n", F.col("score").alias(f"l{i}"))
        one = functionalities.select(F.col("p").alias(f"_p{i}"), F.col("score").alias(f"_one{i}"))
        two = pair_functionalities.select(F.col("p1").alias(f"_a{i}"), F.col("p2").alias(f"_b{i}"), F.col("score").alias(f"_two{i}"))
        out = (
            out.join(local, [f"seq{i}", "n"])
            .withColumn(f"_p{i}", F.when(F.col("n") == 1, F.col(f"q{i}")))
            .withColumn(f"_a{i}", F.when(F.col("n") == 2, F.least(f"q{i}", f"_before{i}")))
            .withColumn(f"_b{i}", F.when(F.col("n") == 2, F.greatest(f"q{i}", f"_before{i}")))
            .join(one, f"_p{i}", "left").join(two, [f"_a{i}", f"_b{i}"], "left")
            .withColumn(f"f{i}", F.coalesce(f"_one{i}", f"_two{i}", F.lit(1.0)))
        )
    score = F.least(F.lit(1.0), F.col("hm"), F.col("hq"), F.col("l1"), F.col("l2"), F.col("f1"), F.col("f2"))
    return out.groupBy(F.col("s1").alias("e1"), F.col("s2").alias("e2")).agg(F.max(score).alias("score")).where("score > 0")


def guarded_merge(scores: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """New scores count only if above the present best match of both ends."""
    best = matches.groupBy("e1").agg(F.max("score").alias("_b"))
    above = (
        new.join(best.withColumnRenamed("_b", "_b1"), "e1", "left")
        .join(best.select(F.col("e1").alias("e2"), F.col("_b").alias("_b2")), "e2", "left")
        .where(F.col("score") > F.coalesce(F.greatest("_b1", "_b2"), F.lit(0.0)))
    )
    return max_merge(scores, above)


def match_literals(
    f1: DataFrame, f2: DataFrame, threshold: float = 0.7, q: int = 3, vectors1: DataFrame | None = None, vectors2: DataFrame | None = None
) -> DataFrame:
    """Literal matches: 1 if equal after normalising, else a cosine from the threshold up.

    The cosine is that of given ``(o, vec)`` tables, or else of q-grams. Literals without a vector match only if equal.

    Two gram sets with cosine t have similar sizes and share at least t * t of the larger one,
    so a match shares one of the rarest grams outside that share.
    """
    def literals(f: DataFrame, i: int) -> DataFrame:
        own = f.where(is_literal("o")).select(F.col("o").alias(f"e{i}")).distinct()
        norm = F.array_join(tx.words(F.col(f"e{i}")), " ")
        return own.withColumn("norm", norm)

    l1, l2 = literals(f1, 1), literals(f2, 2)
    equal = l1.where("norm <> ''").join(l2, "norm").select("e1", "e2", F.lit(1.0).alias("score"))
    identical = l1.join(l2, F.col("e1") == F.col("e2")).select("e1", "e2", F.lit(1.0).alias("score"))
    if vectors1 is not None and vectors2 is not None:
        own = lambda v, l, i: v.select(F.col("o").alias(f"e{i}"), "vec").join(l, f"e{i}", "left_semi")
        close = cosine_links(own(vectors1, l1, 1), own(vectors2, l2, 2), threshold, "e1", "e2")
        return max_merge(equal.unionAll(identical), close.select(F.col("id_1").alias("e1"), F.col("id_2").alias("e2"), "score"))
    grams = lambda l, i: l.where("norm <> ''").select(f"e{i}", F.array_distinct(tx.qgrams(F.col("norm"), q)).alias(f"g{i}"))
    g1, g2 = grams(l1, 1), grams(l2, 2)
    counts = (
        g1.select(F.explode("g1").alias("t")).unionAll(g2.select(F.explode("g2").alias("t"))).groupBy("t").agg(F.count("*").alias("df"))
    )

    def prefix(g: DataFrame, i: int) -> DataFrame:
        listed = g.select(f"e{i}", F.explode(f"g{i}").alias("t")).join(counts, "t").groupBy(f"e{i}").agg(
            F.array_sort(F.collect_list(F.struct("df", "t"))).alias("_l")
        )
        length = F.size("_l") - F.ceil(F.size("_l") * F.lit(threshold * threshold - 1e-9)).cast("int") + 1
        return listed.select(f"e{i}", F.explode(F.slice("_l", 1, length)).alias("_x")).select(f"e{i}", "_x.t")

    near = prefix(g1, 1).join(prefix(g2, 2), "t").select("e1", "e2").distinct()
    scored = near.join(g1, "e1").join(g2, "e2").select("e1", "e2", tx.set_cosine(F.col("g1"), F.col("g2")).alias("score"))
    close = scored.where(F.col("score") >= threshold - 1e-12)
    return max_merge(equal.unionAll(identical), close)


def align_kbs(
    f1: DataFrame,
    f2: DataFrame,
    seeds: DataFrame,
    given_predicates: DataFrame | None = None,
    alpha: float = 3.0,
    init: float = 0.7,
    default: float = 0.1,
    gram_n: int | None = None,
    epsilon: float = 0.1,
    max_iter: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Matches and predicate subsumption of two knowledge bases, iterated until they settle.

    Every round writes its matches and predicate scores to the shared folder; the only values
    that come to the driver are the score sums of the stop test. It ends after ``max_iter``
    rounds if a caller says so, and raises if it does not settle otherwise.
    """
    f1, f2 = cut(f1, "facts"), cut(f2, "facts")
    fun = cut(merge_functionality(functionality(f1), functionality(f2), ["p"]), "functionality")
    pairs = cut(merge_functionality(functionality_pairs(f1), functionality_pairs(f2), ["p1", "p2"]), "functionality")
    sub = cut(init_subsumption(f1, f2, given_predicates, default), "subsumption")
    scores = cut(max_merge(seeds, match_literals(f1, f2, init)), "scores")
    scores = cut(bootstrap(f1, f2, scores, sub, fun, dominated=False), "scores")
    matches = cut(bilateral_max(scores), "matches")
    sub = cut(map_subrelations(f1, f2, matches, sub, alpha), "subsumption")
    quasi = cut(quasi_equivalence(sub, f1, f2), "quasi")
    total = lambda d: d.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    before = total(matches)
    for _ in range(ROUND_LIMIT if max_iter is None else max_iter):
        evidence = search_evidence(f1, f2, matches, quasi, gram_n, HEAVY_DEGREE)
        new = apply_rules(select_candidates(cut(evidence, "evidence"), matches), f1, f2, fun, pairs)
        scores = cut(guarded_merge(scores, new, matches), "scores")
        matches = cut(bilateral_max(scores), "matches")
        sub = cut(map_subrelations(f1, f2, matches, sub, alpha), "subsumption")
        quasi = cut(quasi_equivalence(sub, f1, f2), "quasi")
        after = total(matches)
        if abs(after - before) < epsilon:
            break
        before = after
    else:
        if max_iter is None:
            raise RuntimeError("align_kbs: scores still moving after ROUND_LIMIT rounds")
    return matches, sub
