"""Candidate generation: blocks, block cleaning and similarity joins.

A block table is long: ``(block_key, side, id)``. ``side`` is 1 or 2 when two clean
tables are linked (``clean_clean=True``) and 1 throughout for one dirty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import text as tx
from tripleweave.plans.rounds import cut

BLOCK_COLUMNS = ["block_key", "side", "id"]
CHUNK = 2048


def entity_texts(df: DataFrame, id_col: str, attrs: list[str] | None = None, side: int = 1) -> DataFrame:
    """``(side, id, text)``; without attributes every column but the id is used."""
    attrs = attrs or [c for c in df.columns if c != id_col]
    text = F.concat_ws(" ", *[F.col(a).cast("string") for a in attrs])
    return df.select(F.lit(side).alias("side"), F.col(id_col).alias("id"), text.alias("text"))


def block_sizes(blocks: DataFrame, clean_clean: bool) -> DataFrame:
    """``(block_key, size, comparisons)`` of the blocks that compare anything."""
    counts = blocks.groupBy("block_key").agg(
        F.count("*").alias("size"),
        F.count(F.when(F.col("side") == 1, 1)).alias("_n1"),
    )
    n, n1 = F.col("size"), F.col("_n1")
    comparisons = n1 * (n - n1) if clean_clean else F.expr("size * (size - 1) div 2")
    return counts.select("block_key", "size", comparisons.alias("comparisons")).where("comparisons > 0")


def with_sizes(blocks: DataFrame, clean_clean: bool) -> DataFrame:
    return blocks.join(block_sizes(blocks, clean_clean), "block_key")


def drop_idle(blocks: DataFrame, clean_clean: bool) -> DataFrame:
    """Only blocks with at least one comparison."""
    return blocks.join(block_sizes(blocks, clean_clean).select("block_key"), "block_key", "left_semi").select(
        *BLOCK_COLUMNS
    )


def _keyed(texts: DataFrame, keys: Column) -> DataFrame:
    return texts.select(F.explode(keys).alias("block_key"), "side", "id")


def standard_blocking(texts: DataFrame, clean_clean: bool = False) -> DataFrame:
    """One block per word; the words are written once, as sizes and rows both read them."""
    return drop_idle(cut(_keyed(texts, tx.tokens(F.col("text"))), "keys"), clean_clean)


def _token_keys(texts: DataFrame, keys_of) -> DataFrame:
    """Keys made from each word; deduplicated inside the row, so no shuffle is needed."""
    keys = F.array_distinct(F.flatten(F.transform(tx.tokens(F.col("text")), keys_of)))
    return _keyed(texts, keys)


def qgrams_blocking(texts: DataFrame, q: int = 3, clean_clean: bool = False) -> DataFrame:
    """One block per character q-gram of a word."""
    return drop_idle(_token_keys(texts, lambda t: tx.qgrams(t, q)), clean_clean)


def gram_combinations(grams: Column, threshold: float) -> Column:
    """Ordered concatenations of every subset of at least floor(k * threshold) grams.

    A subset that large leaves out at most ``k - floor(k * threshold)`` grams: walk the grams
    once and branch into "take" and "leave out" while leaving out is still allowed.
    """
    k = F.size(grams)
    spare = k - F.greatest(F.lit(1), F.floor(k * F.lit(threshold)).cast("int"))
    empty = F.array(F.struct(F.lit("").alias("key"), F.lit(0).alias("out")))
    states = F.aggregate(
        grams,
        empty,
        lambda acc, g: F.flatten(
            F.transform(
                acc,
                lambda s: F.filter(
                    F.array(
                        F.struct(F.concat(s["key"], g).alias("key"), s["out"].alias("out")),
                        F.struct(s["key"].alias("key"), (s["out"] + 1).alias("out")),
                    ),
                    lambda n: n["out"] <= spare,
                ),
            )
        ),
    )
    return F.transform(states, lambda s: s["key"])


def extended_qgrams_blocking(
    texts: DataFrame, q: int = 3, threshold: float = 0.95, clean_clean: bool = False
) -> DataFrame:
    """Blocks on concatenated large q-gram subsets of a word."""
    per_word = texts.select("side", "id", F.explode(tx.tokens(F.col("text"))).alias("_word"))
    # Words repeat across entities: build the combinations once per distinct word.
    keys = per_word.select("_word").distinct().select(
        "_word", F.explode(F.array_distinct(gram_combinations(tx.qgrams(F.col("_word"), q), threshold))).alias("block_key")
    )
    return drop_idle(per_word.join(keys, "_word").select(*BLOCK_COLUMNS).distinct(), clean_clean)


def _size_limited(blocks: DataFrame, max_block_size: int | None, clean_clean: bool) -> DataFrame:
    blocks = cut(blocks, "keys")
    if max_block_size is None:
        return drop_idle(blocks, clean_clean)
    fitting = block_sizes(blocks, clean_clean).where(F.col("size") <= max_block_size)
    return blocks.join(fitting.select("block_key"), "block_key", "left_semi").select(*BLOCK_COLUMNS)


def suffix_arrays_blocking(
    texts: DataFrame, suffix_length: int = 6, max_block_size: int | None = None, clean_clean: bool = False
) -> DataFrame:
    """Blocks on word suffixes; larger blocks go only if a caller names a size."""
    return _size_limited(_token_keys(texts, lambda t: tx.suffixes(t, suffix_length)), max_block_size, clean_clean)


def extended_suffix_arrays_blocking(
    texts: DataFrame, suffix_length: int = 6, max_block_size: int | None = None, clean_clean: bool = False
) -> DataFrame:
    """Blocks on all word substrings of at least the given length; larger blocks go only if a caller names a size."""
    return _size_limited(_token_keys(texts, lambda t: tx.substrings(t, suffix_length)), max_block_size, clean_clean)


def block_purging(blocks: DataFrame, smoothing: float = 1.025, clean_clean: bool = False) -> DataFrame:
    """Drop the blocks above the size level where comparisons outgrow assignments.

    The levels (distinct comparison counts) are few; only they pass through a window.
    """
    sizes = block_sizes(blocks, clean_clean)
    levels = sizes.groupBy("comparisons").agg(
        F.sum("comparisons").alias("_c"), F.sum("size").cast("double").alias("_b")
    )
    upto = Window.orderBy("comparisons").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = levels.select(
        "comparisons", F.sum(F.col("_c").cast("double")).over(upto).alias("_cc"), F.sum("_b").over(upto).alias("_bc")
    )
    nxt = Window.orderBy("comparisons")
    turning = (
        cumulative.select(
            "*",
            F.lead("comparisons").over(nxt).alias("_limit"),
            F.lead("_cc").over(nxt).alias("_next_cc"),
            F.lead("_bc").over(nxt).alias("_next_bc"),
        )
        .where(F.col("_bc") * F.col("_next_cc") < smoothing * F.col("_cc") * F.col("_next_bc"))
        .agg(F.max("_limit").alias("_limit"))
    )
    kept = sizes.where(F.col("comparisons") <= F.coalesce(turning.scalar(), F.lit((1 << 62))))
    return blocks.join(kept.select("block_key"), "block_key", "left_semi").select(*BLOCK_COLUMNS)


def block_filtering(blocks: DataFrame, ratio: float = 0.8, clean_clean: bool = False) -> DataFrame:
    """Every entity keeps its ``ratio`` smallest blocks (at least one)."""
    sized = with_sizes(cut(blocks, "blocks"), clean_clean)
    entity = Window.partitionBy("side", "id")
    kept = (
        sized.withColumn("_rn", F.row_number().over(entity.orderBy("comparisons", "block_key")))
        .withColumn("_n", F.count("*").over(entity))
        .where(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(ratio))))
    )
    # Written: the sizes that are left and the rows both need the ranking.
    return drop_idle(cut(kept.select(*BLOCK_COLUMNS), "kept"), clean_clean)


# --- overlap joins ---------------------------------------------------------------------


def overlap_tokens(
    col: Column, word_level: bool = True, q: int = 3, stop_words: list[str] | None = None
) -> Column:
    """Distinct words or q-grams of a value, without stop words; NULL and '' give no tokens."""
    value = F.coalesce(F.lower(col.cast("string")), F.lit(""))
    if stop_words or word_level:
        kept = tx.words(value)
        if stop_words:
            stop = F.array(*[F.lit(s) for s in stop_words])
            kept = F.filter(kept, lambda t: ~F.array_contains(stop, t))
        value = kept if word_level else F.array_join(kept, " ")
    return F.array_distinct(value if word_level else tx.qgrams(value, q))


def _missing(col: Column) -> Column:
    return F.coalesce(F.trim(col.cast("string")), F.lit("")) == ""


#: Rows up to which a table may be sent to every task.
FEW = 100_000


def _met(df: DataFrame, other: DataFrame, on: str, rows: int) -> DataFrame:
    """Inner join with a table of ``rows`` rows: sizes of token lists are not known to the planner, so a longer table is never sent whole."""
    return df.join(other if rows <= FEW else other.hint("merge"), on)


def _rarity_prefix(rows: DataFrame, frequency: DataFrame, overlap_size: int, n_tokens: int) -> DataFrame:
    """Of every token set its rarest ``size - overlap_size + 1`` tokens.

    Two sets sharing ``overlap_size`` tokens must share one inside these prefixes, so the
    frequent tokens - the hot join keys - mostly drop out without losing a pair.
    """
    exploded = rows.select("id", F.explode("tokens").alias("token"))
    listed = (
        exploded.join(F.broadcast(frequency) if n_tokens <= FEW else frequency.hint("merge"), "token")  # counted
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_t"))
    )
    length = F.size("_t") - overlap_size + 1
    return listed.where(length > 0).select("id", F.explode(F.slice("_t", 1, length)).alias("_x")).select("id", "_x.token")


def _overlapping(left: DataFrame, right: DataFrame, overlap_size: int) -> DataFrame:
    """``(id_1, id_2, overlap)`` of ``(id, tokens)`` tables.

    Where the prefixes bring a large share of all pairs together, common tokens are counted in the cells of a grid, which lists
    no candidates; otherwise candidates are listed and meet their tokens.
    """
    left, right = [cut(d.where(F.col("id").isNotNull() & (F.size("tokens") >= overlap_size)), "token_sets") for d in (left, right)]
    n_1, n_2 = left.count(), right.count()
    every = left.select("tokens").unionAll(right.select("tokens"))
    frequency = cut(every.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")), "frequency")
    n_tokens = frequency.count()
    lp, rp = [cut(_rarity_prefix(d, frequency, overlap_size, n_tokens), "prefixes") for d in (left, right)]
    counts = [d.groupBy("token").agg(F.count("*").cast("double").alias(f"n_{i}")) for i, d in enumerate((lp, rp), 1)]
    listed = counts[0].join(counts[1], "token").agg(F.sum(F.col("n_1") * F.col("n_2"))).first()[0] or 0.0
    if 8 * listed >= n_1 * n_2:
        from tripleweave.operators import meta  # it builds on this module

        return meta.overlaps(left, right, overlap_size)
    candidates = lp.select(F.col("id").alias("id_1"), "token")
    pairs = _met(candidates, rp.select(F.col("id").alias("id_2"), "token"), "token", rp.count()).select("id_1", "id_2").distinct()
    pairs = _met(pairs, left.select(F.col("id").alias("id_1"), F.col("tokens").alias("_l")), "id_1", n_1)
    pairs = _met(pairs, right.select(F.col("id").alias("id_2"), F.col("tokens").alias("_r")), "id_2", n_2)
    overlap = F.size(F.array_intersect("_l", "_r")).cast("bigint").alias("overlap")
    return pairs.select("id_1", "id_2", overlap).where(F.col("overlap") >= overlap_size)


def overlap_blocking(
    a: DataFrame,
    b: DataFrame,
    id_a: str,
    id_b: str,
    attr_a: str,
    attr_b: str,
    word_level: bool = True,
    q: int = 3,
    overlap_size: int = 1,
    stop_words: list[str] | None = None,
    allow_missing: bool = False,
    l_out: tuple[str, ...] = (),
    r_out: tuple[str, ...] = (),
) -> DataFrame:
    """``(id_1, id_2, overlap)`` for pairs sharing at least ``overlap_size`` tokens."""
    toks = lambda c: overlap_tokens(F.col(c), word_level, q, stop_words)
    left = a.select(F.col(id_a).alias("id"), toks(attr_a).alias("tokens"))
    right = b.select(F.col(id_b).alias("id"), toks(attr_b).alias("tokens"))
    out = _overlapping(left, right, overlap_size)
    if allow_missing:
        out = out.union(_missing_pairs(a, b, id_a, id_b, attr_a, attr_b))
    return _with_outputs(out, a, b, id_a, id_b, l_out, r_out)


def _missing_pairs(a, b, id_a, id_b, attr_a, attr_b, buckets: int = 64) -> DataFrame:
    """Every pair with a missing value: asked for by ``allow_missing``, spread over buckets."""
    left = a.select(F.col(id_a).alias("id_1"), _missing(F.col(attr_a)).alias("_ml"))
    right = b.select(F.col(id_b).alias("id_2"), _missing(F.col(attr_b)).alias("_mr"))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b")
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("_b")
    from_left = left.where("_ml").select("id_1", every).join(right.select("id_2", of("id_2")), "_b")
    from_right = left.where("NOT _ml").select("id_1", of("id_1")).join(right.where("_mr").select("id_2", every), "_b")
    return from_left.select("id_1", "id_2", F.lit(0).cast("bigint").alias("overlap")).union(
        from_right.select("id_1", "id_2", F.lit(0).cast("bigint").alias("overlap"))
    )


def _with_outputs(pairs, a, b, id_a, id_b, l_out, r_out) -> DataFrame:
    if l_out:
        pairs = pairs.join(a.select(F.col(id_a).alias("id_1"), *[F.col(c).alias(f"l_{c}") for c in l_out]), "id_1")
    if r_out:
        pairs = pairs.join(b.select(F.col(id_b).alias("id_2"), *[F.col(c).alias(f"r_{c}") for c in r_out]), "id_2")
    return pairs


def overlap_test(
    pairs: DataFrame,
    a: DataFrame,
    b: DataFrame,
    id_a: str,
    id_b: str,
    attr_a: str,
    attr_b: str,
    word_level: bool = True,
    q: int = 3,
    overlap_size: int = 1,
    stop_words: list[str] | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """The pair table with a ``blocked`` verdict: true when the pair would be left out."""
    toks = lambda c: overlap_tokens(F.col(c), word_level, q, stop_words)
    left = a.select(F.col(id_a).alias("id_1"), toks(attr_a).alias("_l"), _missing(F.col(attr_a)).alias("_ml"))
    right = b.select(F.col(id_b).alias("id_2"), toks(attr_b).alias("_r"), _missing(F.col(attr_b)).alias("_mr"))
    shared = F.size(F.array_intersect("_l", "_r")) >= overlap_size
    passes = shared | F.col("_ml") | F.col("_mr") if allow_missing else shared
    return (
        pairs.join(left, "id_1").join(right, "id_2").withColumn("blocked", ~passes).drop("_l", "_r", "_ml", "_mr")
    )


def overlap_filter_pairs(pairs: DataFrame, *args, **kwargs) -> DataFrame:
    """Only the pairs that pass the overlap test."""
    return overlap_test(pairs, *args, **kwargs).where("NOT blocked").drop("blocked")


# --- nearest neighbours ----------------------------------------------------------------


#: Pivots of a nearest-neighbour search, each a vector on the driver.
MOST_PIVOTS = 512
#: Error that squared distances may carry.
ROUNDING = 1e-9


#: Vector components in one batch of rows that leave a task.
COMPONENTS = 1 << 21


def in_pieces(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` rows that hold at most ``COMPONENTS`` components (one row at least): a vector asks many cells."""
    step = max(1, COMPONENTS // max(width, 1))
    for at in range(0, rows, step):
        yield slice(at, at + step)


def _search(k: int):
    """k nearest members of one chunk for one chunk of queries, in strips of queries."""

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"id_1": [], "id_2": [], "distance": []})
        members = members.sort_values("id")
        m = np.stack(members["vec"].to_numpy())
        # Of equal vectors only the k smallest ids can be among the nearest.
        _, name = np.unique(m, axis=0, return_inverse=True)
        first = pd.Series(name.ravel()).groupby(name.ravel()).cumcount().to_numpy() < k
        m, ids = m[first], members["id"].to_numpy()[first]
        own, last, found = (m * m).sum(1), min(k, len(m)) - 1, []
        for at in in_pieces(len(queries), len(m)):
            part = queries.iloc[at]
            q = np.stack(part["vec"].to_numpy())
            squared = (q * q).sum(1)[:, None] + own[None, :] - 2.0 * (q @ m.T)
            # These values are rounded: all within rounding error of the k-th are kept, exact scores come later.
            row, col = np.nonzero(squared <= np.partition(squared, last, axis=1)[:, last : last + 1] + ROUNDING)
            found.append((part["id"].to_numpy()[row], ids[col], np.sqrt(np.maximum(squared[row, col], 0.0))))
        return pd.DataFrame(dict(zip(("id_1", "id_2", "distance"), map(np.concatenate, zip(*found)))))

    return search


def _in_bins(centres: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Number of the bin of each cell: near cells one after the other, up to ``most`` members in a bin (or one cell)."""
    left, at, bins, held, number = set(range(len(sizes))), 0, np.zeros(len(sizes), dtype="int32"), 0, 0
    while left:
        left.discard(at)
        if held and held + sizes[at] > most:
            held, number = 0, number + 1
        bins[at], held = number, held + sizes[at]
        rest = np.array(sorted(left), dtype=int)
        if len(rest):
            at = int(rest[((centres[rest] - centres[at]) ** 2).sum(1).argmin()])
    return bins


def _to_pivots(centres: np.ndarray, vec: pd.Series, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (scaled to length 1 if ``unit``) and their distances to every pivot."""
    v = np.stack(vec.to_numpy()).astype("float64")
    if unit:
        length = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
    squared = (v * v).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (v @ centres.T)
    return v, np.sqrt(np.maximum(squared, 0.0))


def embedding_blocking(
    a: DataFrame,
    b: DataFrame,
    k: int,
    metric: str = "cosine",
    id_col: str = "id",
    vec_col: str = "vec",
    pivots: int | None = None,
) -> DataFrame:
    """Exact k nearest rows of ``b`` for every row of ``a``: ``(id_1, id_2, score, rank)``.

    ``b`` is cut into cells around pivots, about the square root of its rows and ``MOST_PIVOTS`` at most. By the triangle inequality a
    query only asks cells that can hold a neighbour closer than its current k-th one, and goes once to each bin of
    such cells; there are about 16 bins, or one for ``COMPONENTS`` vector components if these are more. Big
    bins and busy bins are cut into chunks. The score is the cosine, or minus the distance.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    unit = metric == "cosine"
    left = a.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    right = b.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    id_1, id_2 = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()

    # A bounded number of rows comes to the driver: the pivots, later one row per cell.
    if pivots is None:
        pivots = max(32, min(MOST_PIVOTS, math.isqrt(right.count())))
    chosen = right.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    centres = np.array([r["vec"] for r in chosen], dtype="float64")
    if unit:
        length = np.sqrt((centres * centres).sum(1, keepdims=True))
        centres = np.divide(centres, length, out=np.zeros_like(centres), where=length > 0)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v, d = _to_pivots(centres, batch["vec"], unit)
            cell = d.argmin(1)
            yield pd.DataFrame(
                {"id": batch["id"], "vec": list(v), "cell": cell.astype("int32"), "d": d[np.arange(len(d)), cell]}
            )

    homes = cut(right.mapInPandas(settle, f"id {id_2}, vec array<double>, cell int, d double"), "cells")
    stats = homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    stats = {r["cell"]: r for r in stats.collect()}
    cells = sorted(stats)
    n, lo, hi = (np.array([stats[c][f] for c in cells], dtype="float64") for f in ("n", "lo", "hi"))
    most = max(CHUNK, min(COMPONENTS // centres.shape[1], int(n.sum()) // 16))
    bins = _in_bins(centres[cells], n, most)
    members = homes.select("cell", "id", "vec")

    def route(with_bound: bool):
        """Send a query to its nearest cell, or to the bins of all cells within its known radius."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                v, d = _to_pivots(centres, batch["vec"], unit)
                d = d[:, cells]
                if with_bound:
                    # k members lie within the reach of the nearest cells that hold k in all.
                    reach = d + hi
                    order = reach.argsort(1)
                    enough = (n[order].cumsum(1) >= k).argmax(1)
                    rows = np.arange(len(d))
                    radius = np.where(n.sum() >= k, reach[rows, order[rows, enough]], np.inf)
                    radius = np.fmin(radius, batch["kth"].to_numpy(dtype="float64")) + 1e-7
                    lower = np.maximum(0.0, np.maximum(d - hi, lo - d))
                    asked = np.zeros((len(d), int(bins.max()) + 1), dtype=bool)
                    row, col = np.nonzero(lower <= radius[:, None])
                    asked[row, bins[col]] = True
                    row, place = np.nonzero(asked)
                else:
                    row, place = np.arange(len(d)), np.array(cells)[d.argmin(1)]
                for at in in_pieces(len(row), v.shape[1]):
                    yield pd.DataFrame(
                        {
                            "id": batch["id"].to_numpy()[row[at]],
                            "vec": [v[i] for i in row[at]],
                            "cell": place[at].astype("int32"),
                        }
                    )

        return run

    schema = f"id_1 {id_1}, id_2 {id_2}, distance double"

    def visit(queries: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
        """Search the places (cells or bins) of the routed queries, chunk of members by part of queries."""
        loads = [d.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias(c)) for d, c in ((queries, "_parts"), (members, "_chunks"))]
        load = F.broadcast(loads[0].join(loads[1], "cell"))  # one row per cell
        part, every = (lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")), (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
        asked = queries.join(load, "cell").select("cell", every("_chunks").alias("chunk"), part("_parts").alias("part"), "id", "vec")
        held = members.join(load, "cell").select("cell", part("_chunks").alias("chunk"), every("_parts").alias("part"), "id", "vec")
        keys = ["cell", "chunk", "part"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_search(k), schema)

    routed = f"id {id_1}, vec array<double>, cell int"
    first = visit(cut(left.mapInPandas(route(False), routed), "routes"), members, CHUNK)
    nth = Window.partitionBy("id_1").orderBy("distance", "id_2")
    kth = (
        first.withColumn("_rn", F.row_number().over(nth))
        .where(F.col("_rn") == k)
        .select(F.col("id_1").alias("id"), F.col("distance").alias("kth"))
    )
    bin_of = np.zeros(len(centres), dtype=int)
    bin_of[cells] = bins
    members = members.withColumn("cell", F.element_at(F.array(*[F.lit(int(x)) for x in bin_of]), F.col("cell") + 1))
    found = visit(cut(left.join(kth, "id", "left").mapInPandas(route(True), routed), "routes"), members, most)
    exact = (
        found.withColumn("_rn", F.row_number().over(nth))
        .withColumn("_k", F.max(F.when(F.col("_rn") <= k, F.col("distance"))).over(Window.partitionBy("id_1")))
        .where(F.col("distance") * F.col("distance") <= F.col("_k") * F.col("_k") + ROUNDING)
        .join(left.select(F.col("id").alias("id_1"), F.col("vec").alias("_l")), "id_1")
        .join(right.select(F.col("id").alias("id_2"), F.col("vec").alias("_r")), "id_2")
    )
    lv, rv = F.col("_l"), F.col("_r")
    norms = tx.vector_norm(lv) * tx.vector_norm(rv)
    gap = F.aggregate(F.zip_with(lv, rv, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    score = F.when(norms > 0, tx.dot(lv, rv) / norms).otherwise(F.lit(0.0)) if unit else -F.sqrt(gap)
    ranked = Window.partitionBy("id_1").orderBy(F.desc(F.round("score", 12)), "id_2")
    return (
        exact.select("id_1", "id_2", score.alias("score"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
    )


# --- learned rules ---------------------------------------------------------------------


def learn_blocking_rules(matches: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Greedy cover of the labelled matches by key rules.

    A rule is a pair of array columns (keys of the left and of the right record); it covers
    a match when the arrays overlap. One aggregate per chosen rule; the result has one row
    per chosen rule, in order, with the number of matches it newly covers.
    """
    spark = matches.sparkSession
    names = list(rules)
    covered = matches.select(*[F.coalesce(F.arrays_overlap(l, r), F.lit(False)).alias(n) for n, (l, r) in rules.items()])
    # One row per distinct coverage pattern is enough, and there are few of those.
    patterns = covered.groupBy(*names).agg(F.count("*").alias("_n"))
    chosen: list[tuple[int, str, int]] = []
    left = patterns
    while len(chosen) < len(names):
        open_names = [n for n in names if n not in {c[1] for c in chosen}]
        gains = left.agg(*[F.coalesce(F.sum(F.when(F.col(n), F.col("_n"))), F.lit(0)).alias(n) for n in open_names]).first()
        best = max(open_names, key=lambda n: (gains[n], -names.index(n)))
        if gains[best] == 0:
            break
        chosen.append((len(chosen) + 1, best, gains[best]))
        left = left.where(~F.col(best))
    return spark.createDataFrame(chosen, "position int, rule string, newly_covered bigint")


def block_pairs(blocks: DataFrame, clean_clean: bool, chunk: int = CHUNK) -> DataFrame:
    """``(id_1, id_2, size, comparisons)`` once per block and comparison.

    Members of a big block are hashed into chunks and chunk meets chunk, so a hot key is
    worked on by many tasks, each holding at most ``chunk`` by ``chunk`` comparisons.
    """
    sized = with_sizes(blocks, clean_clean)
    parts = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    member = sized.select(
        "block_key", "side", "id", "size", "comparisons", parts.alias("_k"),
        F.pmod(F.xxhash64("id"), parts).cast("int").alias("_c"),
    )
    if clean_clean:
        left = member.where("side = 1").select(
            "block_key", F.col("id").alias("id_1"), "size", "comparisons", F.col("_c").alias("_c1"),
            F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_c2"),
        )
        right = member.where("side = 2").select(
            "block_key", F.col("id").alias("id_2"), F.col("_c").alias("_c2"),
            F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_c1"),
        )
        joined = left.join(right, ["block_key", "_c1", "_c2"])
    else:
        left = member.select(
            "block_key", F.col("id").alias("_a"), "size", "comparisons", F.col("_c").alias("_c1"),
            F.explode(F.sequence(F.col("_c"), F.col("_k") - 1)).alias("_c2"),
        )
        right = member.select(
            "block_key", F.col("id").alias("_b"), F.col("_c").alias("_c2"),
            F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("_c1"),
        )
        joined = (
            left.join(right, ["block_key", "_c1", "_c2"])
            .where("_c1 < _c2 OR _a < _b")
            .withColumn("id_1", F.least("_a", "_b"))
            .withColumn("id_2", F.greatest("_a", "_b"))
        )
    return joined.select("id_1", "id_2", "size", "comparisons")
