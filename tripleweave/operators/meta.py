"""Comparison cleaning: weight candidate pairs by their shared blocks and prune.

``edges`` are ``(id_1, id_2, weight)``; node-based operators tell the two sides apart by
``side`` when ``clean_clean`` is set, so the ids of two tables may coincide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.blocking import block_sizes
from tripleweave.plans.rounds import cut, global_rank, top_per_group

SCHEMES = [
    "CBS", "CN-CBS", "SN-CBS", "ECBS", "JS", "EJS", "X2", "COSINE", "DICE",
    "CNC", "SNC", "CND", "SND", "CNJ", "SNJ",
]

# A weight counts as equal to a mean or a maximum within this relative difference, so the
# order in which a sum was built cannot move an edge over the border.
SLACK = 1.0 - 1e-9


#: Least number of entities of one side in a cell of the comparison grid.
SPAN = 1024
#: Shared blocks counted at once in a cell.
STEP = 1 << 21
#: Chunks of a side, and with them the copies of an entity, until a chunk has as many entities as one task is given.
MOST_CHUNKS, MOST_ENTITIES = 64, 1 << 16


def _parts(members: DataFrame, clean_clean: bool, span: int) -> tuple[int, int]:
    """Chunks of both sides, of about ``span`` entities; beside a small side the other one has larger chunks.

    Chunks grow with the table, so what the grid shuffles grows with the table and not with its square.
    """
    counts = dict(members.groupBy("side").agg(F.count("id")).collect())
    n1, n2 = counts.get(1, 0), counts.get(2 if clean_clean else 1, 0)
    bound = lambda n, k: max(1, min(k, max(MOST_CHUNKS, -(-n // MOST_ENTITIES))))
    parts = lambda n, other: bound(n, -(-n // min(8 * span, max(span, 2 * span * span // max(other, 1)))))
    return (parts(n1, n2), parts(n2, n1)) if clean_clean else (bound(n1, -(-n1 // span)),) * 2


def _grid(members: DataFrame, clean_clean: bool, span: int, compare: Callable, schema: str) -> DataFrame:
    """``compare(left, right, twice)`` of every cell of a grid of entities with their blocks: chunk meets chunk, every comparison lies in one cell.

    An entity is one row, so a cell counts shared blocks alone; rows of pairs are never shuffled. ``compare`` yields tables, which leave
    the task one by one. ``twice``: the cell compares a chunk of a dirty table with itself.
    """
    two = 2 if clean_clean else 1
    k1, k2 = _parts(members, clean_clean, span)
    chunk = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda first, last: F.explode(F.sequence(first, last))
    rest = [c for c in members.columns if c != "side"]
    left = members.where("side = 1").withColumn("_c1", chunk(k1))
    right = members.where(F.col("side") == two).withColumn("_c2", chunk(k2))
    zero = F.lit(0)
    left = left.select("_c1", every(zero if clean_clean else F.col("_c1"), F.lit(k2 - 1)).alias("_c2"), F.lit(1).alias("_s"), *rest)
    if not clean_clean:
        right = right.where("_c2 > 0")
    right = right.select(every(zero, F.lit(k1 - 1) if clean_clean else F.col("_c2") - 1).alias("_c1"), "_c2", F.lit(2).alias("_s"), *rest)

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        twice = not clean_clean and key[0] == key[1]
        one = rows.filter(pc.equal(rows["_s"], 1))
        other = one if twice else rows.filter(pc.equal(rows["_s"], 2))
        if len(one) and len(other):
            for found in compare(one, other, twice):
                yield from found.combine_chunks().to_batches()

    return left.unionAll(right).groupBy("_c1", "_c2").applyInArrow(cell, schema)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers in place of values, and the values; null is a value."""
    coded = pa.concat_arrays(column.chunks).dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    """The values of all lists of a column."""
    return pa.concat_arrays(lists.chunks).flatten().to_numpy(zero_copy_only=False)


def _holders(table: pa.Table) -> np.ndarray:
    """Place of the entity of every block listed."""
    lengths = pc.list_value_length(pa.concat_arrays(table["block"].chunks)).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(table)), lengths)


def _ids(table: pa.Table) -> pa.Array:
    return pa.concat_arrays(table["id"].chunks)


def _shared_blocks(left: pa.Table, right: pa.Table, twice: bool, common: list[str]):
    """The pairs of a cell, some rows of it at a time: ``(rows, columns, sums)``, the sums those of ``common``; each pair counts once."""
    i, j = _holders(left), _holders(right)
    keys, _ = _coded(pa.chunked_array([pa.concat_arrays(t["block"].chunks).flatten() for t in (left, right)]))
    if not len(i) or not len(j):
        return
    k1, k2 = keys[: len(i)], keys[len(i) :]
    order = np.argsort(k2, kind="stable")
    j, n = j[order], np.bincount(k2, minlength=keys.max() + 1)
    starts, met = np.cumsum(n) - n, n[k1]
    met_at = met > 0
    i, starts, met = [x[met_at] for x in (i, starts[k1], met)]
    weights = {c: 1.0 / _flat(left[WEIGHED[c]])[met_at] for c in common if c in WEIGHED}
    width = len(right)
    count = ["common", *weights]
    ends = np.cumsum(met)
    tall = max(1, SPAN * SPAN // width)
    for first in range(0, len(left), tall):
        at, stop = np.searchsorted(i, (first, first + tall))
        if at == stop:
            continue
        size = min(tall, len(left) - first) * width
        dense = size <= 4 * met[at:stop].sum()
        sums, seen = dict.fromkeys(count, 0), []
        while at < stop:
            # Rows up to STEP shared blocks, one row at least.
            to = min(stop, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right"))))
            m = met[at:to]
            row = np.repeat(np.arange(at, to), m)
            col = j[starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)]
            pair = (i[row] - first).astype("int64") * width + col
            if twice:
                once = i[row] < col
                row, pair = row[once], pair[once]
            if dense:
                for c in count:
                    sums[c] = sums[c] + np.bincount(pair, weights[c][row] if c in weights else None, size)
            else:
                found, place = np.unique(pair, return_inverse=True)
                seen.append((found, {c: np.bincount(place, weights[c][row] if c in weights else None) for c in count}))
            at = to
        if dense:
            pairs = np.flatnonzero(sums["common"])
            sums = {c: s[pairs] for c, s in sums.items()}
        else:
            pairs, place = np.unique(np.concatenate([s for s, _ in seen]), return_inverse=True)
            sums = {c: np.bincount(place, np.concatenate([s[c] for _, s in seen]), len(pairs)) for c in count}
        yield pairs // width + first, pairs % width, sums


def _per_entity(table: pa.Table, stats: list[str]) -> dict[str, np.ndarray]:
    """Statistics of the entities of a chunk."""
    holder = _holders(table)
    out = {"n": np.bincount(holder, minlength=len(table))}
    for name, column in (("cn", "comparisons"), ("sn", "size")):
        if name in stats:
            out[name] = np.bincount(holder, 1.0 / _flat(table[column]), len(table))
    if "degree" in stats:
        out["degree"] = table["degree"].to_numpy()
    return out


COMMON = ["common", "common_cn", "common_sn"]
#: The size of a block by which its count is divided.
WEIGHED = {"common_cn": "comparisons", "common_sn": "size"}


def _measured(left: pa.Table, right: pa.Table, twice: bool, stats: list[str]):
    """``(rows, columns, values)`` of a cell, the values those of ``stats``: shared ones, then those of the entities by side."""
    common, entity = [c for c in COMMON if c in stats], [c for c in stats if c not in COMMON]
    ends = [_per_entity(t, entity) for t in (left, right)]
    for i, j, sums in _shared_blocks(left, right, twice, common):
        values = {c: sums[c] for c in common}
        values.update({f"{c}_{s}": e[c][at] for s, (e, at) in enumerate(zip(ends, (i, j)), 1) for c in entity})
        yield i, j, values


def _shared(members: DataFrame, clean_clean: bool, stats: list[str], span: int) -> DataFrame:
    """``(id_1, id_2)`` of every comparison with the shared blocks and entity statistics named."""
    kind = members.schema["id"].dataType.simpleString()
    types = {c: "bigint" if c in ("common", "n", "degree") else "double" for c in [*COMMON, "n", "cn", "sn", "degree"]}
    common, entity = [c for c in COMMON if c in stats], [c for c in stats if c not in COMMON]
    columns = [(c, types[c]) for c in common] + [(f"{c}_{s}", types[c]) for s in (1, 2) for c in entity]
    schema = ", ".join([f"_a {kind}", f"_b {kind}", *[f"{c} {t}" for c, t in columns]])

    def compare(left: pa.Table, right: pa.Table, twice: bool):
        ids_1, ids_2 = _ids(left), _ids(right)
        for i, j, values in _measured(left, right, twice, stats):
            kept = [pa.array(np.asarray(values[c]).astype("int64" if t == "bigint" else "float64")) for c, t in columns]
            yield pa.table([ids_1.take(pa.array(i)), ids_2.take(pa.array(j)), *kept], ["_a", "_b", *[c for c, _ in columns]])

    found = _grid(members, clean_clean, span, compare, schema)
    if clean_clean:
        return found.withColumnsRenamed({"_a": "id_1", "_b": "id_2"})
    ahead = F.col("_a") < F.col("_b")
    ordered = [F.when(ahead, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in ((1, 2), (2, 1)) for c in entity]
    return found.select(F.least("_a", "_b").alias("id_1"), F.greatest("_a", "_b").alias("id_2"), *common, *ordered)


# --- edges that a pruning or clustering can use, chosen in the cells --------------------


def _rounded(w: np.ndarray, decimals: int | None) -> np.ndarray:
    """Half up by decimal digits, as Spark rounds."""
    if decimals is None:
        return w
    scaled = w * 10.0**decimals
    out = np.floor(scaled + 0.5)
    close = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(close):
        values, place = np.unique(w[close], return_inverse=True)
        exact = [Decimal(repr(float(v))).scaleb(decimals).quantize(Decimal(1), ROUND_HALF_UP) for v in values]
        out[close] = np.array(exact, dtype="float64")[place]
    return out / 10.0**decimals


def _first(grid: np.ndarray, k: int) -> np.ndarray:
    """Marks the ``k`` largest numbers of each row; of equal ones the first. Numbers of -1 are empty places."""
    if grid.shape[1] <= k:
        return grid >= 0
    border = np.partition(grid, grid.shape[1] - k, axis=1)[:, [grid.shape[1] - k]]
    above = grid > border
    equal = grid == border
    room = k - above.sum(axis=1, keepdims=True)
    return (above | (equal & (np.cumsum(equal, axis=1) <= room))) & (grid >= 0)


def _best_of_ends(strips, least: tuple[np.ndarray, np.ndarray], k: int):
    """``(rows, columns, weights, whether it is the row's)``: edges of a cell among the ``k`` best of an end there; entities are in the order of their ids.

    ``least``: what an edge of each end must weigh.
    """
    width = len(least[1])
    best = np.full((0, width), -1.0)
    rows = np.zeros((0, width), dtype="int64")
    for i, j, w in strips:
        if not len(i):
            continue
        low = i.min()
        grid = np.full((i.max() - low + 1, width), -1.0)
        grid[i - low, j] = w
        x, y = np.nonzero(_first(np.where(grid >= least[0][low : low + len(grid), None], grid, -1.0), k))
        yield x + low, y, grid[x, y], True
        # The best of each column so far come before those of later rows.
        stacked = np.concatenate([best, np.where(grid >= least[1], grid, -1.0)])
        places = np.concatenate([rows, np.broadcast_to(np.arange(low, low + len(grid))[:, None], grid.shape)])
        col, at = np.nonzero(_first(np.ascontiguousarray(stacked.T), k))
        n = np.bincount(col, minlength=width)
        rank = np.arange(len(col)) - np.repeat(np.cumsum(n) - n, n)
        best, rows = np.full((n.max(), width), -1.0), np.zeros((n.max(), width), dtype="int64")
        best[rank, col], rows[rank, col] = stacked[at, col], places[at, col]
    x, y = np.nonzero(best >= 0)
    yield rows[x, y], y, best[x, y], False


def _forest(strips, shape: tuple[int, int], twice: bool, threshold: float):
    """Edges above a threshold that hold together what all such edges of a cell hold together, without a circle."""
    beside = 0 if twice else shape[0]
    label = np.arange(beside + shape[1])
    for i, j, w in strips:
        above = np.flatnonzero(w > threshold)
        i, j, w = i[above], j[above], w[above]
        while True:
            a, b = label[i], label[j + beside]
            apart = a != b
            if not apart.any():
                break
            i, j, w, a, b = [x[apart] for x in (i, j, w, a, b)]
            # Each higher label takes one edge to a lower one.
            high, at = np.unique(np.maximum(a, b), return_index=True)
            to = np.arange(len(label))
            to[high] = np.minimum(a, b)[at]
            yield i[at], j[at], w[at]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]


#: Weights lie in 4096 steps between powers of two.
_BITS = 40


def _with_least(members: DataFrame, clean_clean: bool, stats, span: int, weigh, decimals, k: int) -> DataFrame:
    """Members with ``least``, a weight that the ``k`` best edges of each reach: the k-th of the few best edges it has in every cell."""
    few = -(-2 * k // max(_parts(members, clean_clean, span)))

    def compare(left: pa.Table, right: pa.Table, twice: bool):
        strips = ((i, j, _rounded(weigh(v), decimals)) for i, j, v in _measured(left, right, twice, stats))
        for i, j, w, of_row in _best_of_ends(strips, (np.zeros(len(left)), np.zeros(len(right))), few):
            ids, side = (_ids(left).take(pa.array(i)), 1) if of_row else (_ids(right).take(pa.array(j)), 2 if clean_clean else 1)
            yield pa.table([pa.array(np.full(len(w), side, dtype="int32")), ids, pa.array(w)], ["side", "id", "w"])

    kind = members.schema["id"].dataType.simpleString()
    seen = _grid(members, clean_clean, span, compare, f"side int, id {kind}, w double")
    # A few numbers per cell of the row of cells, whose number is bounded.
    kth = seen.groupBy("side", "id").agg(F.collect_list("w").alias("_w")).select(
        "side", "id", F.get(F.sort_array("_w", asc=False), F.lit(k - 1)).alias("least")
    )
    return cut(members.join(kth, ["side", "id"], "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "least")


def _cell_edges(members, clean_clean: bool, stats, span: int, weigh, decimals, choose) -> DataFrame:
    """``(id_1, id_2, weight)`` of the edges that ``choose`` takes from the strips of a cell."""
    kind = members.schema["id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table, twice: bool):
        left = left.sort_by("id")
        right = left if twice else right.sort_by("id")
        ids_1, ids_2 = _ids(left), _ids(right)
        strips = ((i, j, _rounded(weigh(v), decimals)) for i, j, v in _measured(left, right, twice, stats))
        for i, j, w in choose(strips, left, right, twice):
            yield pa.table([ids_1.take(pa.array(i)), ids_2.take(pa.array(j)), pa.array(w)], ["_a", "_b", "weight"])

    found = _grid(members, clean_clean, span, compare, f"_a {kind}, _b {kind}, weight double")
    if clean_clean:
        return found.withColumnsRenamed({"_a": "id_1", "_b": "id_2"})
    return found.select(F.least("_a", "_b").alias("id_1"), F.greatest("_a", "_b").alias("id_2"), "weight")


def _border(members, clean_clean: bool, stats, span: int, weigh, decimals, k: int) -> float:
    """A weight that at least ``k`` edges reach, if there are so many, and few more: edges are counted by steps of weight."""

    def compare(left: pa.Table, right: pa.Table, twice: bool):
        for _, _, v in _measured(left, right, twice, stats):
            step = _rounded(weigh(v), decimals).view("int64") >> _BITS
            if len(step):
                low = step.min()
                n = np.bincount(step - low)
                met = np.flatnonzero(n)
                yield pa.table([pa.array(met + low), pa.array(n[met].astype("int64"))], ["step", "n"])

    counted = _grid(members, clean_clean, span, compare, "step bigint, n bigint").groupBy("step").agg(F.sum("n")).collect()
    reached = 0
    for step, n in sorted(counted, reverse=True):  # steps are bounded, whatever the number of edges
        reached += n
        if reached >= k:
            return float(np.int64(step << _BITS).view("float64"))
    return 0.0


def _members(blocks: DataFrame, clean_clean: bool, stats: list[str]) -> DataFrame:
    """``(side, id, block, ...)``, written: an entity is one row that lists the numbers of its blocks, with their sizes if ``stats`` need them.

    An entity without an id of a dirty table has no comparisons.
    """
    sizes = block_sizes(blocks, clean_clean).withColumn("block", F.monotonically_increasing_id())
    listed = ["block", *[c for c, used in (("comparisons", ("common_cn", "cn")), ("size", ("common_sn", "sn"))) if {*used} & {*stats}]]
    # Written: both uses of the numbers must see the same ones.
    rows = blocks.join(cut(sizes.select("block_key", *listed), "sizes"), "block_key")
    rows = rows if clean_clean else rows.where("id IS NOT NULL")
    packed = rows.groupBy("side", "id").agg(F.collect_list(F.struct(*listed)).alias("_l"))
    return cut(packed.select("side", "id", *[F.col("_l")[c].alias(c) for c in listed]), "members")


def _degrees(members: DataFrame, clean_clean: bool, span: int) -> DataFrame:
    """``(side, id, degree)``: comparisons of every entity, added up cell by cell."""
    kind = members.schema["id"].dataType.simpleString()

    def count(left: pa.Table, right: pa.Table, twice: bool):
        side = np.repeat([1, 2 if clean_clean else 1], [len(left), len(right)]).astype("int32")
        n_1, n_2 = np.zeros(len(left), "int64"), np.zeros(len(right), "int64")
        for i, j, _ in _shared_blocks(left, right, twice, []):
            n_1 += np.bincount(i, minlength=len(left))
            n_2 += np.bincount(j, minlength=len(right))
        yield pa.table([pa.array(side), pa.concat_arrays([_ids(left), _ids(right)]), pa.array(np.concatenate([n_1, n_2]))], ["side", "id", "degree"])

    found = _grid(members, clean_clean, span, count, f"side int, id {kind}, degree bigint")
    return found.groupBy("side", "id").agg(F.sum("degree").alias("degree")).where("degree > 0")


def overlaps(left: DataFrame, right: DataFrame, least: int, span: int = SPAN) -> DataFrame:
    """``(id_1, id_2, overlap)`` of rows ``(id, tokens)`` of two tables that share at least ``least`` tokens; a row is an entity, whatever its id."""
    kinds = [d.schema["id"].dataType for d in (left, right)]
    named = [
        d.select(F.lit(side).alias("side"), *[(F.col("id") if side == s else F.lit(None).cast(kinds[s - 1])).alias(f"id_{s}") for s in (1, 2)], F.col("tokens").alias("block"))
        for side, d in ((1, left), (2, right))
    ]
    sets = cut(named[0].unionAll(named[1]).withColumn("id", F.monotonically_increasing_id()), "sets")

    def compare(left: pa.Table, right: pa.Table, _: bool):
        ids_1, ids_2 = [pa.concat_arrays(t[c].chunks) for t, c in ((left, "id_1"), (right, "id_2"))]
        for i, j, sums in _shared_blocks(left, right, False, ["common"]):
            met = sums["common"] >= least
            n = pa.array(np.asarray(sums["common"][met]).astype("int64"))
            yield pa.table([ids_1.take(pa.array(i[met])), ids_2.take(pa.array(j[met])), n], ["id_1", "id_2", "overlap"])

    schema = ", ".join(f"id_{s} {k.simpleString()}" for s, k in enumerate(kinds, 1)) + ", overlap bigint"
    return _grid(sets, True, span, compare, schema)


def comparison_propagation(blocks: DataFrame, clean_clean: bool = False, span: int = SPAN) -> DataFrame:
    """Every comparison once, with its block statistics."""
    return _shared(_members(blocks, clean_clean, COMMON), clean_clean, COMMON, span)


def _nodes(edges: DataFrame, clean_clean: bool, *cols: str) -> DataFrame:
    """Both ends of every edge as ``(side, id, ...)``."""
    one = edges.select(F.lit(1).alias("side"), F.col("id_1").alias("id"), *cols)
    two = edges.select(F.lit(2 if clean_clean else 1).alias("side"), F.col("id_2").alias("id"), *cols)
    return one.unionAll(two)


def _attach(edges: DataFrame, nodes: DataFrame, clean_clean: bool) -> DataFrame:
    """Join the node columns to both ends with suffixes _1 and _2."""
    cols = [c for c in nodes.columns if c not in ("side", "id")]
    first = nodes.where("side = 1").select(F.col("id").alias("id_1"), *[F.col(c).alias(f"{c}_1") for c in cols])
    side = 2 if clean_clean else 1
    second = nodes.where(F.col("side") == side).select(
        F.col("id").alias("id_2"), *[F.col(c).alias(f"{c}_2") for c in cols]
    )
    return edges.join(first, "id_1").join(second, "id_2")


def _cosine(c: Column, a: Column, b: Column) -> Column:
    return c / F.sqrt(a * b)


def _dice(c: Column, a: Column, b: Column) -> Column:
    return 2.0 * c / (a + b)


def _jaccard(c: Column, a: Column, b: Column) -> Column:
    return c / (a + b - c)


def _chi_square(c: Column, a: Column, b: Column, total: Column) -> Column:
    """Chi-square of the 2x2 table of shared and unshared blocks, no continuity correction."""
    only_a, only_b = a - c, b - c
    neither = total - a - b + c
    margins = a * (total - a) * b * (total - b)
    diff = c * neither - only_a * only_b
    return F.when(margins > 0, total * diff * diff / margins).otherwise(F.lit(0.0))


def _chosen_edges(blocks, scheme: str, clean_clean: bool, span: int, only: str, threshold: float, decimals: int | None) -> DataFrame:
    forms = {"JS": _jaccard, "DICE": _dice, "CND": _dice, "SND": _dice, "CNJ": _jaccard, "SNJ": _jaccard}
    if scheme not in forms:
        raise ValueError(f"edges are chosen in the cells under {sorted(forms)} only")
    form = forms[scheme]
    common, entity = ("common", "n") if scheme in ("JS", "DICE") else {"C": ("common_cn", "cn"), "S": ("common_sn", "sn")}[scheme[0]]
    weigh = lambda v: form(v[common], v[f"{entity}_1"], v[f"{entity}_2"])
    stats = [common, entity]
    members = _members(blocks, clean_clean, stats).where("id IS NOT NULL")
    cells = (members, clean_clean, stats, span, weigh, decimals)
    if only == "connecting":
        return _cell_edges(*cells, lambda strips, left, right, twice: _forest(strips, (len(left), len(right)), twice, threshold))
    if only == "best of ends":
        k = blocks.select(_ends_kept(blocks, clean_clean).alias("k")).first()
        k = int(k["k"]) if k and k["k"] else 1
        cells = (_with_least(*cells, k), *cells[1:])

        def best(strips, left, right, _):
            least = [t["least"].to_numpy() for t in (left, right)]
            return ((i, j, w) for i, j, w, _ in _best_of_ends(strips, least, k))

        return _cell_edges(*cells, best).distinct()  # an edge can be among the best of both ends
    if only == "best":
        k = _edges_kept(blocks, clean_clean).first()["k"] or 0
        least = _border(*cells, k)
        return _cell_edges(*cells, lambda strips, *_: ((i[w >= least], j[w >= least], w[w >= least]) for i, j, w in strips))
    raise ValueError(f"unknown choice {only!r}")


def edge_weights(
    blocks: DataFrame, scheme: str = "EJS", clean_clean: bool = False, span: int = SPAN,
    only: str | None = None, threshold: float = 0.0, decimals: int | None = None,
) -> DataFrame:
    """``(id_1, id_2, weight)`` under one of the weighting schemes.

    ``only`` leaves edges out where they are counted, for an operator whose result they cannot change: ``"best"`` for
    ``cardinality_edge_pruning``, ``"best of ends"`` for the two cardinality prunings of nodes, ``"connecting"`` for the
    connected components above ``threshold`` (JS, DICE, CND, SND, CNJ, SNJ). Weights are rounded to ``decimals`` before.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}; one of {SCHEMES}")
    if only is not None:
        return _chosen_edges(blocks, scheme, clean_clean, span, only, threshold, decimals)
    plain = {"CBS": "common", "CN-CBS": "common_cn", "SN-CBS": "common_sn"}
    if scheme in plain:
        edges = _shared(_members(blocks, clean_clean, [plain[scheme]]), clean_clean, [plain[scheme]], span)
        return edges.select("id_1", "id_2", F.col(plain[scheme]).cast("double").alias("weight"))

    stat = {"C": "cn", "S": "sn"}[scheme[0]] if scheme in ("CNC", "CND", "CNJ", "SNC", "SND", "SNJ") else None
    needed = [f"common_{stat}", stat] if stat else ["common", "n"]
    members = _members(blocks, clean_clean, needed)
    if scheme == "EJS":
        degrees = cut(_degrees(members, clean_clean, span), "degrees")
        members = members.join(degrees, ["side", "id"])
        needed.append("degree")
    joined = _shared(members, clean_clean, needed, span).where("id_1 IS NOT NULL AND id_2 IS NOT NULL")
    d = lambda name: F.col(name).cast("double")
    total = block_sizes(blocks, clean_clean).agg(F.count("*").cast("double").alias("b")).scalar()
    if stat:
        form = {"C": _cosine, "D": _dice, "J": _jaccard}[scheme[2]]
        weight = form(d(f"common_{stat}"), d(f"{stat}_1"), d(f"{stat}_2"))
        return joined.select("id_1", "id_2", weight.alias("weight"))
    c, n1, n2 = d("common"), d("n_1"), d("n_2")
    if scheme == "ECBS":
        weight = c * F.log10(total / n1) * F.log10(total / n2)
    elif scheme == "JS":
        weight = _jaccard(c, n1, n2)
    elif scheme == "EJS":
        # Both ends of a dirty table's comparisons are counted.
        ends = degrees.where("side = 1").agg(F.sum("degree").alias("e")).scalar()
        count = (ends if clean_clean else ends / 2).cast("double")
        weight = _jaccard(c, n1, n2) * F.log10(count / d("degree_1")) * F.log10(count / d("degree_2"))
    elif scheme == "X2":
        weight = _chi_square(c, n1, n2, total)
    elif scheme == "COSINE":
        weight = _cosine(c, n1, n2)
    else:
        weight = _dice(c, n1, n2)
    return joined.select("id_1", "id_2", weight.alias("weight"))


def weighted_edge_pruning(edges: DataFrame) -> DataFrame:
    """Edges at or above the mean weight."""
    edges = cut(edges, "edges")
    mean = edges.agg(F.avg("weight").alias("m")).scalar()
    return edges.where(F.col("weight") >= mean * SLACK)


def _node_means(edges: DataFrame, clean_clean: bool) -> DataFrame:
    """Edges with the means of their ends. Only the means are written; the edges, which can be nearly all pairs, are made twice."""
    means = _nodes(edges, clean_clean, "weight").groupBy("side", "id").agg(F.avg("weight").alias("mean"))
    return _attach(edges, cut(means, "means"), clean_clean)


def weighted_node_pruning(edges: DataFrame, clean_clean: bool = False) -> DataFrame:
    """Edges at or above the mean weight of one of their ends."""
    return _node_means(edges, clean_clean).where(
        (F.col("weight") >= F.col("mean_1") * SLACK) | (F.col("weight") >= F.col("mean_2") * SLACK)
    ).select("id_1", "id_2", "weight")


def reciprocal_weighted_node_pruning(edges: DataFrame, clean_clean: bool = False) -> DataFrame:
    """Edges at or above the mean weight of both ends."""
    return _node_means(edges, clean_clean).where(
        (F.col("weight") >= F.col("mean_1") * SLACK) & (F.col("weight") >= F.col("mean_2") * SLACK)
    ).select("id_1", "id_2", "weight")


def blast(edges: DataFrame, clean_clean: bool = False) -> DataFrame:
    """Edges (chi-square weights) at or above a quarter of the summed maxima of both ends."""
    tops = _nodes(edges, clean_clean, "weight").groupBy("side", "id").agg(F.max("weight").alias("top"))
    return _attach(edges, cut(tops, "tops"), clean_clean).where(
        F.col("weight") >= (F.col("top_1") + F.col("top_2")) / 4.0 * SLACK
    ).select("id_1", "id_2", "weight")


def _edges_kept(blocks: DataFrame, clean_clean: bool) -> DataFrame:
    return block_sizes(blocks, clean_clean).agg(F.floor(F.sum("size") / 2).alias("k"))


def _ends_kept(blocks: DataFrame, clean_clean: bool) -> Column:
    """Edges that an end keeps."""
    sizes = block_sizes(blocks, clean_clean).agg(F.sum("size").alias("s")).scalar()
    entities = blocks.select("side", "id").distinct().agg(F.count("*").alias("n")).scalar()
    return F.greatest(F.lit(1), F.floor(sizes / entities))


def cardinality_edge_pruning(edges: DataFrame, blocks: DataFrame, clean_clean: bool = False) -> DataFrame:
    """The K best edges, K half the number of block assignments."""
    k = _edges_kept(blocks, clean_clean).scalar()
    ranked = global_rank(edges, [F.desc("weight"), F.asc("id_1"), F.asc("id_2")])
    return ranked.where(F.col("rank") <= k).select("id_1", "id_2", "weight")


def _top_ends(edges: DataFrame, blocks: DataFrame, clean_clean: bool) -> DataFrame:
    k = _ends_kept(blocks, clean_clean)
    ends = _nodes(edges, clean_clean, "id_1", "id_2", "weight")
    return top_per_group(
        ends, ["side", "id"], [F.desc("weight"), F.asc("id_1"), F.asc("id_2")], k, ["id_1", "id_2"]
    )


def cardinality_node_pruning(edges: DataFrame, blocks: DataFrame, clean_clean: bool = False) -> DataFrame:
    """Edges among the k best of one of their ends."""
    return _top_ends(edges, blocks, clean_clean).select("id_1", "id_2", "weight").distinct()


def reciprocal_cardinality_node_pruning(edges: DataFrame, blocks: DataFrame, clean_clean: bool = False) -> DataFrame:
    """Edges among the k best of both ends."""
    ends = _top_ends(edges, blocks, clean_clean)
    return ends.groupBy("id_1", "id_2", "weight").agg(F.count("*").alias("_n")).where("_n = 2").drop("_n")
