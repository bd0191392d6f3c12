"""Cleaning for matching, profiling, sampling and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.functions import text as tx
from tripleweave.operators.learning import hash_share
from tripleweave.plans.rounds import top_per_group

# Common English function words.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her",
    "his", "i", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "our", "she", "so", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "which", "will",
    "with", "you",
]


def clean_for_matching(
    df: DataFrame,
    *columns: str,
    stopwords: bool = True,
    punctuation: bool = True,
    numbers: bool = True,
    unicodes: bool = True,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """Lower-case the columns and take out what the four switches name."""
    stop = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None else STOP_WORDS)])
    out = df
    for name in columns:
        col = F.lower(F.col(name))
        if unicodes:
            col = F.regexp_replace(col, r"[^\x00-\x7F]", "")
        if punctuation:
            col = F.regexp_replace(col, r"[^\p{L}\p{N}_\s]", "")
        if numbers:
            col = F.regexp_replace(col, r"[0-9]+", "")
        parts = F.filter(F.split(col, r"\s+"), lambda t: t != "")
        if stopwords:
            parts = F.filter(parts, lambda t: ~F.array_contains(stop, t))
        out = out.withColumn(name, F.array_join(parts, " "))
    return out


def profile(df: DataFrame, top: int = 3, quantiles: tuple[float, ...] = ()) -> DataFrame:
    """One row per column: counts, extremes, mean, deviation, most frequent values.

    Everything is computed from (column, value) counts, so each value passes the second
    shuffle once however often it occurs. Quantiles are approximate and only on request.
    """
    numeric = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")}
    long = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    number = F.when(F.col("column").isin(*numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    valued = counts.withColumn("x", number)
    seen = F.col("value").isNotNull()
    total_x = F.sum(F.when(F.col("x").isNotNull(), F.col("n")))
    mean = F.sum(F.col("x") * F.col("n")) / total_x
    stats = valued.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        F.min("x").alias("min_number"),
        F.max("x").alias("max_number"),
        mean.alias("mean"),
        total_x.alias("_total"),
    )
    # deviations from the mean itself: a sum of squares loses them where the mean is large
    gap = F.col("x") - F.col("_mean")
    spread = valued.join(stats.select("column", F.col("mean").alias("_mean")), "column").groupBy("column").agg(F.sum(gap * gap * F.col("n")).alias("_gaps"))
    stats = stats.join(spread, "column").withColumn("std", F.when(F.col("_total") > 1, F.sqrt(F.col("_gaps") / (F.col("_total") - 1)))).drop("_total", "_gaps")
    if quantiles:
        share = F.percentile_approx("x", list(quantiles)).alias("quantiles")
        stats = stats.join(long.withColumn("x", number).groupBy("column").agg(share), "column")
    order = [F.desc("n"), F.asc("value")]
    best = top_per_group(counts.where(seen), ["column"], order, top, ["value"])
    listed = best.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("value")))).alias("_t")
    ).select("column", F.array_join(F.transform("_t", lambda t: t["value"]), " | ").alias("top_values"))
    return stats.join(listed, "column", "left")


def down_sample(a: DataFrame, b: DataFrame, id_a: str, id_b: str, size: int, y: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``size`` rows of ``b`` by hash, and for each the ``y`` rows of ``a`` sharing most tokens."""
    def toks(df: DataFrame, key: str) -> DataFrame:
        text = F.concat_ws(" ", *[F.col(c).cast("string") for c, t in df.dtypes if t == "string" and c != key])
        return df.select(F.col(key).alias("id"), F.explode(tx.tokens(text)).alias("token"))

    chosen = b.orderBy(F.xxhash64(F.col(id_b), F.lit(seed)), id_b).limit(size)
    left, right = toks(a, id_a).withColumnRenamed("id", "id_1"), toks(chosen, id_b).withColumnRenamed("id", "id_2")
    shared = left.join(right, "token").groupBy("id_2", "id_1").agg(F.count("*").alias("n"))
    best = top_per_group(shared, ["id_2"], [F.desc("n"), F.asc("id_1")], y, ["id_1"])
    kept = best.select(F.col("id_1").alias(id_a)).distinct()
    return a.join(kept, id_a, "left_semi"), chosen


def split_train_test(df: DataFrame, keys: list[str], train_share: float, seed: int = 0) -> DataFrame:
    """The table with ``part`` = train or test, by key hash: stable under repartitioning."""
    inside = hash_share(keys, seed) < int(train_share * 10_000)
    return df.withColumn("part", F.when(inside, "train").otherwise("test"))


def impute_mean(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Missing numbers replaced by the column mean."""
    numeric = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint") and n not in exclude]
    if not numeric:
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in numeric])
    return df.select(
        *[F.coalesce(F.col(c).cast("double"), means.select(c).scalar()).alias(c) if c in numeric else F.col(c) for c in df.columns]
    )
