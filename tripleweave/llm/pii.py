"""Personal data by weak supervision, in DataFrame and SQL functions alone.

1. Candidates: the base patterns, and looser ones beside them (spelled-out addresses, numbers in
   national notation, card numbers that fail the checksum, long addresses, keys). Each gives spans.
2. Labelers vote yes, no or nothing on every candidate: the strict pattern with its checks, the
   shape of the value, a gazetteer, and cue words before the span.
3. Vote patterns are counted over all documents; expectation-maximisation over these counts (at
   most 3 to the number of labelers per kind) estimates each labeler's reliability.
4. The posteriors train the span classifier: log-odds of bucketed features per kind, from sums over
   all candidates. Candidates that it accepts and that touch no base span are added.

All four base kinds stay as their patterns and checks find them. Spans are code points, end exclusive.

Defined cases: null is the empty text; a text without candidates has no spans; repeated rows are
searched each by itself; a table without candidates trains nothing and adds nothing.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import id_text
from tripleweave.plans.rounds import cut

# The base patterns. Look-behind and \G only keep a search from starting inside a run
# that was already tried; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
ORDER = list(BASE)

# Looser patterns of the same kinds, and keys.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[a-z0-9-]{1,63})++",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{32,}+|(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9_-])",
}
# What must be in a text before a pattern is tried on it.
NEEDS = {("email", 0): "@", ("ip", 0): ".", ("phone", 0): "+", ("ip", 1): ":"}

# Gazetteers and cue words.
TOP_DOMAINS = "com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|us|eu|ch|at|nl"
CUES = {
    "email": "mail|contact|write to|reach",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|credit|debit|payment|pan",
    "phone": "phone|tel|call|mobile|fax|cell|dial",
    "secret": "key|token|secret|password|passwd|pwd|api",
}
CONTEXT = 24
LABELERS = ["pattern", "shape", "gazetteer", "context"]


def _found(text: str, kind: str, loose: int) -> Column:
    """Matches of one pattern: what lies before each (its length and last characters) and the match."""
    pattern = F.lit((LOOSE if loose else BASE)[kind])
    gaps = F.split(text, (LOOSE if loose else BASE)[kind], -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.transform(
        F.arrays_zip(gaps.alias("gap"), matches.alias("match")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), x["match"].alias("match")),
    )
    kept = F.filter(pairs, lambda x: x["match"].isNotNull())
    none = F.array().cast("array<struct<gap:int,before:string,match:string>>")
    need = NEEDS.get((kind, loose))
    return F.when(F.contains(F.col(text), F.lit(need)), kept).otherwise(none) if need else kept


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, doc_id, kind, loose, start, end, match, before)``; a text without any gives one row without a kind."""
    rows = id_text(docs, id_col, text).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    searches = [(k, 0) for k in BASE] + [(k, 1) for k in LOOSE]
    every = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(loose).alias("loose"), _found("text", k, loose).alias("found")) for k, loose in searches
    ])
    hits = rows.select("row", "doc_id", F.filter(every, lambda s: F.size(s["found"]) > 0).alias("every"))
    one = hits.select("row", "doc_id", F.explode_outer("every").alias("s")).select(
        "row", "doc_id", "s.kind", "s.loose", F.posexplode_outer("s.found").alias("i", "m")
    )
    order = Window.partitionBy("row", "kind", "loose").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.length("m.match")).over(order)
    return one.select(
        "row", "doc_id", "kind", "loose", (end - F.length("m.match")).alias("start"), end.alias("end"), "m.match", "m.before"
    )


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    reverse = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(reverse, lambda c, i: F.when(c == "", 0).when(i % 2 == 1, (c.cast("int") * 2 % 10) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + x,
    )
    return total % 10 == 0


def _checked(kind: Column, match: Column, digits: Column) -> Column:
    """The checks of a base match."""
    octets = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(octets, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    size = F.length(digits)
    return (
        F.when(kind == "email", True).when(kind == "ip", small)
        .when(kind == "card", F.when(size.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(10, 15)).otherwise(False)
    )


def _any(values: dict[str, str], kind: Column, text: Column) -> Column:
    out = F.lit(False)
    for k, words in values.items():
        out = F.when(kind == k, F.regexp_like(text, F.lit(f"(?i)(?<![a-z])(?:{words})"))).otherwise(out)
    return out


def with_votes(found: DataFrame) -> DataFrame:
    """Candidates with ``is_base``, the four votes (1, 0, or null) and the bucketed features."""
    rows = found.where("kind IS NOT NULL").withColumn("digits", F.regexp_replace("match", "[^0-9]", ""))
    kind, match, digits = F.col("kind"), F.col("match"), F.col("digits")
    size = F.length(digits)
    rows = rows.withColumn("is_base", (F.col("loose") == 0) & _checked(kind, match, digits))
    # an unchecked match of a base pattern is a candidate if it is near the shape of its kind
    rows = rows.where(
        (F.col("loose") == 1) | F.col("is_base") | ((kind == "card") & size.between(13, 19)) | ((kind == "phone") & size.between(7, 15))
    )
    shape = (
        F.when(kind == "email", F.regexp_like(match, F.lit(r"\.[A-Za-z]{2,10}$")))
        .when(kind == "ip", ~F.regexp_like(match, F.lit(r"^0")) | (F.col("loose") == 1))
        .when(kind == "card", size.isin(15, 16))
        .when(kind == "phone", size.between(10, 13))
        .otherwise(F.regexp_like(match, F.lit("[0-9]")) & F.regexp_like(match, F.lit("[A-Za-z]")))
    )
    gazetteer = (
        F.when(kind == "email", F.regexp_like(match, F.lit(rf"(?i)(?:\.|dot.?\x20?)(?:{TOP_DOMAINS})$")))
        .when(kind == "card", F.regexp_like(digits, F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6)")))
        .when(kind == "phone", F.when(F.startswith(match, F.lit("+")), F.regexp_like(match, F.lit(r"^\+[1-9]"))))
        .when(kind == "ip", F.when(F.col("loose") == 0, ~F.regexp_like(match, F.lit(r"^(?:0|2[4-9][0-9])\."))))
    )
    context = F.when(_any(CUES, kind, F.col("before")), True)
    votes = {"pattern": F.col("is_base"), "shape": shape, "gazetteer": gazetteer, "context": context}
    return rows.select(
        "row", "doc_id", "kind", "loose", "start", "end", "match", "is_base",
        *[v.cast("int").alias(f"v_{n}") for n, v in votes.items()],
        F.least(F.floor(F.length("match") / 4), F.lit(12)).cast("int").alias("f_length"),
        F.floor(4 * size / F.length("match")).cast("int").alias("f_digits"),
        F.least(F.length(F.regexp_replace("match", "[A-Za-z0-9]", "")), F.lit(6)).alias("f_marks"),
        F.coalesce(context.cast("int"), F.lit(0)).alias("f_cue"),
    )


def reliabilities(patterns: list[tuple], rounds: int = 50) -> tuple[dict, dict]:
    """EM per kind over ``(kind, votes, count)``: rates of a yes vote given a true and a false span, and posteriors."""
    rates, posteriors = {}, {}
    for kind in sorted({p[0] for p in patterns}):
        own = [(votes, n) for k, votes, n in patterns if k == kind]
        prior, yes, no = 0.5, [0.9] * len(LABELERS), [0.2] * len(LABELERS)
        for _ in range(rounds):
            post = {}
            for votes, _n in own:
                a, b = math.log(prior), math.log(1 - prior)
                for v, p, q in zip(votes, yes, no, strict=True):
                    if v is not None:
                        a += math.log(p if v else 1 - p)
                        b += math.log(q if v else 1 - q)
                post[votes] = 1 / (1 + math.exp(min(50, max(-50, b - a))))
            total = sum(n for _, n in own)
            true = sum(post[v] * n for v, n in own)
            prior = (true + 1) / (total + 2)
            for i in range(len(LABELERS)):
                cast = [(v, n) for v, n in own if v[i] is not None]
                hit, seen = sum(post[v] * n for v, n in cast if v[i]), sum(post[v] * n for v, n in cast)
                wrong, unseen = sum((1 - post[v]) * n for v, n in cast if v[i]), sum((1 - post[v]) * n for v, n in cast)
                # smoothed towards a labeler that is right more often than not
                yes[i], no[i] = (hit + 1.8) / (seen + 2), (wrong + 0.4) / (unseen + 2)
        rates[kind] = dict(zip(LABELERS, zip(yes, no, strict=True), strict=True))
        posteriors.update({(kind, v): p for v, p in post.items()})
    return rates, posteriors


VOTES = [f"v_{n}" for n in LABELERS]
FEATURES = ["f_length", "f_digits", "f_marks", "f_cue"]


def _lookup(values: dict[tuple, float], cols: list[str], otherwise: float) -> Column:
    if not values:
        return F.lit(otherwise)
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols])
    pairs = [F.lit(x) for k, v in values.items() for x in ("/".join("-" if p is None else str(p) for p in k), float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(otherwise))


def classified(voted: DataFrame) -> DataFrame:
    """``voted`` with ``p``: the trained classifier's probability that a candidate is personal data."""
    patterns = [(r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in voted.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()]
    _, posterior = reliabilities(patterns)
    soft = voted.withColumn("soft", _lookup({(k, *v): p for (k, v), p in posterior.items()}, ["kind", *VOTES], 0.5))
    # grouping sets: one small table of soft sums per kind and per feature value
    sums = soft.groupBy("kind", *FEATURES).agg(F.sum("soft").alias("t"), F.count("*").alias("n")).collect()
    logit = F.lit(0.0)
    base: dict[str, list[float]] = {}
    per: dict[str, dict[tuple, list[float]]] = {f: {} for f in FEATURES}
    for r in sums:
        for target in [base.setdefault(r["kind"], [0.0, 0.0]), *[per[f].setdefault((r["kind"], r[f]), [0.0, 0.0]) for f in FEATURES]]:
            target[0] += r["t"]
            target[1] += r["n"] - r["t"]
    prior = {(k,): math.log((t + 1) / (f + 1)) for k, (t, f) in base.items()}
    logit = _lookup(prior, ["kind"], 0.0)
    for f in FEATURES:
        weights = {}
        for (kind, value), (t, n) in per[f].items():
            all_t, all_n = base[kind]
            weights[(kind, value)] = math.log((t + 0.5) / (all_t + 1)) - math.log((n + 0.5) / (all_n + 1))
        logit = logit + _lookup(weights, ["kind", f], 0.0)
    return soft.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), logit)))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``(row, doc_id, kind, start, end, match, is_base, p)``: all spans; a text without any has one row without a kind."""
    found = cut(candidates(docs, id_col, text), "candidates")
    voted = cut(with_votes(found), "voted")
    scored = classified(voted).where(F.col("is_base") | (F.col("p") >= least))
    # an added span gives way to a base span that it touches, then to the added span that starts first
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    clear = (
        scored.withColumn("base_end", F.max(F.when(F.col("is_base"), F.col("end"))).over(before))
        .withColumn("base_start", F.min(F.when(F.col("is_base"), F.col("start"))).over(after))
        .where("is_base OR (coalesce(base_end, -1) <= start AND coalesce(base_start, end) >= end)")
    )
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind", "loose").rowsBetween(Window.unboundedPreceding, -1)
    spans = clear.withColumn("taken", F.max(F.when(~F.col("is_base"), F.col("end"))).over(earlier)).where("is_base OR coalesce(taken, -1) <= start")
    return (
        found.select("row", "doc_id").distinct()
        .join(spans.select("row", "kind", "start", "end", "match", "is_base", "p"), "row", "left")
    )


def digest(spans: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans."""
    place = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(ORDER)], F.lit(len(ORDER)))
    entry = F.struct("start", place.alias("place"), "end", "kind")
    text = lambda col: F.array_join(F.transform(F.array_sort(col), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return spans.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("is_base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in ORDER],
        F.sha2(text(F.collect_list(F.when(F.col("is_base"), entry))), 256).alias("base_sha256"),
        text(F.collect_list(F.when(F.col("kind").isNotNull(), entry))).alias("spans"),
    ).drop("row")


def vote_patterns() -> int:
    """Bound of the collected vote table per kind."""
    return len(list(product((None, 0, 1), repeat=len(LABELERS))))
