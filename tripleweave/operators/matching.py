"""Scoring of candidate pairs, comparison features and match quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tripleweave.functions import text as tx
from tripleweave.plans.rounds import cut, global_rank

#: Entities of one side in a cell when many pairs are scored.
SPAN = 1024
METRICS = ["cosine", "dice", "sorensen_dice", "jaccard"]


def tokenise(col: Column, level: str = "char", q: int = 3) -> Column:
    """All words, or all character q-grams of the lower-cased text, repeats kept."""
    if level == "word":
        return tx.words(col)
    if level == "char":
        return tx.qgrams(F.lower(col), q)
    raise ValueError(f"level must be 'word' or 'char', not {level!r}")


def vectorise(texts: DataFrame, level: str = "char", q: int = 3, weighting: str = "tfidf") -> DataFrame:
    """Sparse vectors ``(side, id, token, weight)`` of ``(side, id, text)``.

    tf-idf uses ``tf * (ln((1 + N) / (1 + df)) + 1)`` and unit length; tf is the raw count and
    boolean is 1.
    """
    # Texts are dealt by entity, so that its tokens are counted where they arise.
    counted = (
        texts.repartition("side", "id").select("side", "id", F.explode(tokenise(F.col("text"), level, q)).alias("token"))
        .groupBy("side", "id", "token")
        .agg(F.count("*").cast("double").alias("tf"))
    )
    if weighting == "tf":
        return counted.select("side", "id", "token", F.col("tf").alias("weight"))
    if weighting == "boolean":
        return counted.select("side", "id", "token", F.lit(1.0).alias("weight"))
    if weighting != "tfidf":
        raise ValueError(f"weighting must be tfidf, tf or boolean, not {weighting!r}")
    counted = cut(counted, "counts")  # read for the frequencies and the weights
    n = texts.agg(F.count("*").cast("double").alias("n")).scalar()
    df = counted.groupBy("token").agg(F.count("*").alias("df"))
    raw = counted.join(df, "token").select(
        "side", "id", "token", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w")
    )
    norms = raw.groupBy("side", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, ["side", "id"]).select("side", "id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def _rows_of(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids of a chunk, the order that puts their rows together and where each begins."""
    coded = pa.concat_arrays(table[name].chunks).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, np.argsort(code, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(code))])


def _common_in_cells(pairs: DataFrame, first: DataFrame, second: DataFrame, k1: int, k2: int) -> DataFrame:
    """Common tokens of pairs, chunk of entities by chunk; a vector meets each chunk of the other side once.

    ``(id_1, id_2, dot, shared, n1, l1, n2, l2)``; a repeated pair counts again.
    """
    chunk = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    kinds = [first.schema["id_1"].dataType, second.schema["id_2"].dataType]
    asked = pairs.select(F.col("id_1").cast(kinds[0]).alias("id_1"), F.col("id_2").cast(kinds[1]).alias("id_2"))
    asked = asked.where("id_1 IS NOT NULL AND id_2 IS NOT NULL")
    left = first.where("id_1 IS NOT NULL").select(
        chunk("id_1", k1).alias("_c1"), every(k2).alias("_c2"), "id_1", F.lit(None).cast(kinds[1]).alias("id_2"), "token", F.col("w1").alias("w")
    ).unionByName(asked.select(
        chunk("id_1", k1).alias("_c1"), chunk("id_2", k2).alias("_c2"), "id_1", "id_2", F.lit(None).cast("string").alias("token"), F.lit(None).cast("double").alias("w")
    ))
    right = second.where("id_2 IS NOT NULL").select(
        every(k1).alias("_c1"), chunk("id_2", k2).alias("_c2"), F.col("id_2").alias("id_2"), F.col("token").alias("token"), F.col("w2").alias("w")
    )
    values = ["dot", "shared", "n1", "l1", "n2", "l2"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.filter(pc.is_valid(left["token"])) if len(left) else left
        wanted = left.filter(pc.is_valid(left["id_2"])) if len(left) else left
        if not len(rows) or not len(wanted) or not len(right):
            types = [to_arrow_type(k) for k in kinds] + [pa.float64()] * len(values)
            return pa.table([pa.array([], t) for t in types], ["id_1", "id_2", *values])
        tokens = pa.concat_arrays([*rows["token"].chunks, *right["token"].chunks]).dictionary_encode()
        token = tokens.indices.to_numpy(zero_copy_only=False)
        sides = []
        for table, name, own in ((rows, "id_1", token[: len(rows)]), (right, "id_2", token[len(rows) :])):
            ids, order, starts = _rows_of(table, name)
            w = table["w"].to_numpy()[order]
            sides.append((ids, own[order], w, starts, np.sqrt(np.add.reduceat(w * w, starts[:-1]))))
        ends = [pc.index_in(wanted[n], s[0]).to_numpy() for n, s in zip(("id_1", "id_2"), sides)]
        known = ~(np.isnan(ends[0].astype("float64")) | np.isnan(ends[1].astype("float64")))
        ends = [e[known].astype("int64") for e in ends]
        width = len(sides[1][0])
        pair, times = np.unique(ends[0] * width + ends[1], return_counts=True)
        ends = [pair // width, pair % width]
        # Entities of the side with longer vectors are laid out one by one, and their partners look up.
        wide = int(len(right) * len(sides[0][0]) >= len(rows) * width)
        (_, tok, w, starts, _), (_, tok_o, w_o, starts_o, _) = sides[wide], sides[1 - wide]
        order = np.argsort(ends[wide], kind="stable")
        groups = np.flatnonzero(np.diff(ends[wide][order], prepend=-1))
        dot, shared = np.zeros(len(pair)), np.zeros(len(pair))
        weight, there = np.zeros(len(tokens.dictionary)), np.zeros(len(tokens.dictionary))
        for g, h in zip(groups, [*groups[1:], len(order)]):
            e = ends[wide][order[g]]
            mine = slice(starts[e], starts[e + 1])
            weight[tok[mine]], there[tok[mine]] = w[mine], 1.0
            for a in range(g, h, 4096):
                at = order[a : min(a + 4096, h)]
                begin = starts_o[ends[1 - wide][at]]
                n = starts_o[ends[1 - wide][at] + 1] - begin
                edge = np.cumsum(n) - n
                look = np.repeat(begin - edge, n) + np.arange(n.sum())
                dot[at] = np.add.reduceat(weight[tok_o[look]] * w_o[look], edge)
                shared[at] = np.add.reduceat(there[tok_o[look]], edge)
            weight[tok[mine]] = there[tok[mine]] = 0.0
        met = np.flatnonzero(shared)
        (i, j), m = [e[met] for e in ends], times[met]
        out = [sides[0][0].take(pa.array(i)), sides[1][0].take(pa.array(j)), pa.array(dot[met] * m), pa.array(shared[met] * m)]
        for s, at in zip(sides, (i, j)):
            out += [pa.array(np.diff(s[3])[at].astype("float64")), pa.array(s[4][at])]
        return pa.table(out, ["id_1", "id_2", *values])

    schema = ", ".join([f"id_1 {kinds[0].simpleString()}, id_2 {kinds[1].simpleString()}", *[f"{v} double" for v in values]])
    found = left.groupBy("_c1", "_c2").cogroup(right.groupBy("_c1", "_c2")).applyInArrow(compare, schema)
    return found.select(*[F.col(c).cast(pairs.schema[c].dataType).alias(c) for c in ("id_1", "id_2")], *values)


def score_pairs(pairs: DataFrame, vectors: DataFrame, metric: str = "cosine", clean_clean: bool = True, span: int = SPAN) -> DataFrame:
    """``(id_1, id_2, score)`` for every candidate pair with a common token."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    two = 2 if clean_clean else 1
    first = vectors.where("side = 1").select(F.col("id").alias("id_1"), "token", F.col("weight").alias("w1"))
    second = vectors.where(F.col("side") == two).select(F.col("id").alias("id_2"), "token", F.col("weight").alias("w2"))
    size = lambda d, c: d.agg(F.count("*"), F.count_distinct(c)).first()
    (rows_1, n_1), (rows_2, n_2) = size(first, "id_1"), size(second, "id_2")
    k1, k2 = max(1, -(-n_1 // span)), max(1, -(-n_2 // span))
    # Cells pay where an entity is in many pairs; a thin list takes its vectors along.
    if rows_1 * k2 + rows_2 * k1 <= pairs.count() * (rows_1 / max(n_1, 1)):
        common = _common_in_cells(pairs, first, second, k1, k2)
    else:
        measure = vectors.groupBy("side", "id").agg(
            F.count("*").cast("double").alias("n"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
        )
        common = (
            pairs.select("id_1", "id_2").join(first, "id_1").join(second, ["id_2", "token"])
            .groupBy("id_1", "id_2")
            .agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"), F.count("*").cast("double").alias("shared"))
            .join(measure.where("side = 1").select(F.col("id").alias("id_1"), F.col("n").alias("n1"), F.col("norm").alias("l1")), "id_1")
            .join(measure.where(F.col("side") == two).select(F.col("id").alias("id_2"), F.col("n").alias("n2"), F.col("norm").alias("l2")), "id_2")
        )
    shared, n1, n2 = F.col("shared"), F.col("n1"), F.col("n2")
    if metric == "cosine":
        score = F.col("dot") / (F.col("l1") * F.col("l2"))
    elif metric == "jaccard":
        score = shared / (n1 + n2 - shared)
    else:
        score = 2.0 * shared / (n1 + n2)
    return common.select("id_1", "id_2", score.alias("score"))


def match_pairs(
    pairs: DataFrame, vectors: DataFrame, metric: str = "cosine", threshold: float = 0.8, clean_clean: bool = True
) -> DataFrame:
    """Candidate pairs scoring above the threshold."""
    return score_pairs(pairs, vectors, metric, clean_clean).where(F.col("score") > threshold)


def match_semantic(
    pairs: DataFrame, a: DataFrame, b: DataFrame, metric: str = "cosine", threshold: float = 0.8,
    id_col: str = "id", vec_col: str = "vec",
) -> DataFrame:
    """Candidate pairs scored on given vectors: cosine, or 1 / (1 + euclidean distance)."""
    left = a.select(F.col(id_col).alias("id_1"), F.col(vec_col).alias("_a"))
    right = b.select(F.col(id_col).alias("id_2"), F.col(vec_col).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    if metric == "cosine":
        norms = tx.vector_norm(x) * tx.vector_norm(y)
        score = F.when(norms > 0, tx.dot(x, y) / norms).otherwise(F.lit(0.0))
    elif metric == "euclidean":
        gap = F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
        score = 1.0 / (1.0 + tx.vector_norm(gap))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return (
        pairs.join(left, "id_1").join(right, "id_2").select("id_1", "id_2", score.alias("score"))
        .where(F.col("score") > threshold)
    )


def best_per_source(matches: DataFrame) -> DataFrame:
    """Per ``id_1`` the row with the highest score, the smaller ``id_2`` on a tie.

    An aggregate, not a window: partial results are combined before the shuffle.
    """
    rest = [c for c in matches.columns if c not in ("id_1", "id_2", "score")]
    best = F.min(F.struct((-F.col("score")).alias("_n"), F.col("id_2"), F.col("score"), *[F.col(c) for c in rest]))
    return matches.groupBy("id_1").agg(best.alias("_b")).select("id_1", "_b.id_2", "_b.score", *[f"_b.{c}" for c in rest])


# --- comparison of records -------------------------------------------------------------


def field_comparators(
    pairs: DataFrame, strings: list[str] = (), texts: dict[str, Column] | None = None, prices: list[str] = ()
) -> DataFrame:
    """Comparison vector of a pair table with ``l_``/``r_`` columns.

    String: normalised edit distance; text: the given similarity (a tf-idf cosine column);
    price: difference of logarithms. Each has a ``<field>_missing`` flag and is 0 when missing.
    """
    out = []
    for f in strings:
        l, r = F.col(f"l_{f}"), F.col(f"r_{f}")
        out += [F.coalesce(1.0 - tx.edit_similarity(l, r), F.lit(0.0)).alias(f"{f}_distance")]
        out += [(l.isNull() | r.isNull()).cast("int").alias(f"{f}_missing")]
    for f, similarity in (texts or {}).items():
        l, r = F.col(f"l_{f}"), F.col(f"r_{f}")
        out += [F.coalesce(1.0 - similarity, F.lit(1.0)).alias(f"{f}_distance")]
        out += [(l.isNull() | r.isNull()).cast("int").alias(f"{f}_missing")]
    for f in prices:
        l, r = F.col(f"l_{f}"), F.col(f"r_{f}")
        usable = (l > 0) & (r > 0)
        out += [F.when(usable, F.abs(F.log(l) - F.log(r))).otherwise(F.lit(0.0)).alias(f"{f}_distance")]
        out += [F.coalesce(~usable, F.lit(True)).cast("int").alias(f"{f}_missing")]
    return pairs.select("id_1", "id_2", *[c for c in ("label",) if c in pairs.columns], *out)


def with_records(pairs: DataFrame, a: DataFrame, b: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """Attach both records as ``l_`` and ``r_`` columns."""
    left = a.select(F.col(id_a).alias("id_1"), *[F.col(c).alias(f"l_{c}") for c in a.columns if c != id_a])
    right = b.select(F.col(id_b).alias("id_2"), *[F.col(c).alias(f"r_{c}") for c in b.columns if c != id_b])
    return pairs.join(left, "id_1").join(right, "id_2")


def default_features(a: DataFrame, b: DataFrame, keys: tuple[str, str], long_columns: tuple[str, ...] = ()) -> dict[str, Column]:
    """Feature list that follows from the types of the shared columns.

    Strings: q-gram and word Jaccard, word cosine, and edit similarity unless the column is
    declared long; numbers: equality, absolute and relative difference.
    """
    features: dict[str, Column] = {}
    types_b = dict(b.dtypes)
    for name, kind in a.dtypes:
        if name in keys or types_b.get(name) is None:
            continue
        l, r = F.col(f"l_{name}"), F.col(f"r_{name}")
        if kind == "string":
            lw, rw = tx.tokens(l), tx.tokens(r)
            features[f"{name}_jac_qgm_3"] = tx.set_jaccard(tx.qgrams(F.lower(l), 3), tx.qgrams(F.lower(r), 3))
            features[f"{name}_jac_words"] = tx.set_jaccard(lw, rw)
            features[f"{name}_cos_words"] = tx.set_cosine(lw, rw)
            if name not in long_columns:
                features[f"{name}_edit"] = tx.edit_similarity(l, r)
        else:
            l, r = l.cast("double"), r.cast("double")
            largest = F.greatest(F.abs(l), F.abs(r))
            features[f"{name}_exact"] = (l == r).cast("double")
            features[f"{name}_abs_diff"] = F.abs(l - r)
            features[f"{name}_rel_diff"] = F.when(largest > 0, F.abs(l - r) / largest).when(l == r, F.lit(0.0))
    return features


def add_feature(features: dict[str, Column], name: str, expr: Column | str) -> dict[str, Column]:
    """A feature declared by the user: any Column or SQL text over ``l_``/``r_`` columns."""
    return {**features, name: F.expr(expr) if isinstance(expr, str) else expr}


def extract_features(pairs: DataFrame, features: dict[str, Column]) -> DataFrame:
    """``(id_1, id_2[, label], feature...)`` of a pair table with both records attached."""
    carried = [c for c in ("label",) if c in pairs.columns]
    return pairs.select("id_1", "id_2", *carried, *[c.alias(n) for n, c in features.items()])


# --- quality ---------------------------------------------------------------------------


def evaluate_matches(pred: DataFrame, truth: DataFrame, top_percents: tuple[int, ...] = ()) -> DataFrame:
    """Precision, recall, F1, and the precision among the best N percent of the predictions.

    ``pred`` is ``(id_1, id_2, score)`` without repeated pairs, ``truth`` ``(id_1, id_2)``.
    """
    gold = truth.select("id_1", "id_2").distinct().withColumn("_gold", F.lit(1))
    judged = pred.join(gold, ["id_1", "id_2"], "left").withColumn("_hit", F.coalesce("_gold", F.lit(0)))
    size = gold.agg(F.count("*").alias("n")).scalar()
    cols = [F.count("*").alias("predicted"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("correct")]
    if top_percents:
        judged = global_rank(judged, [F.desc("score"), F.asc("id_1"), F.asc("id_2")])
        total = pred.agg(F.count("*").alias("n")).scalar()
        for p in top_percents:
            inside = F.col("rank") <= F.ceil(total * F.lit(p) / 100)
            cols.append(F.avg(F.when(inside, F.col("_hit"))).alias(f"precision_top_{p}"))
    counted = judged.agg(*cols).withColumn("truth", size)
    precision = F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("truth") > 0, F.col("correct") / F.col("truth")).otherwise(F.lit(0.0))
    return (
        counted.withColumn("precision", precision).withColumn("recall", recall)
        .withColumn("f1", F.when(F.col("correct") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    )
