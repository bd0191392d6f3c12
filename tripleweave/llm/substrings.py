"""Repeated word sequences, by suffix trees over prefix partitions of the suffixes.

A text's suffixes begin at its words; a *window* is the first ``size`` words of a suffix that has as many.
Suffixes with a common prefix of ``size`` words meet in a tree node at least that deep, so each such node is
a repeat and all its suffixes but the first are repeats of an earlier one.

* **Prefixes.** Neighbouring windows would travel with nearly the same words, so a window is filed under one
  of the suffixes that begin in it: the one whose prefix of ``GRAM`` words has the least hash. Equal windows
  choose the same prefix, and a run of windows that choose one travels as one piece of text.
  Prefixes are counted over all rows first. One that stands in a single place is a leaf of the whole tree and is not
  sent (a bit table of bounded size tells; where it is full, leaves are sent and dropped later). One that
  more than ``HOT_WINDOWS`` windows choose is lengthened to the whole window, so that no group outgrows memory.
* **Groups.** Prefixes are dealt to groups of about ``GROUP_BYTES`` by their hash; the number of groups
  follows the windows counted.
* **Subtrees.** A task grows the tree of a group by levels of 1, 2, 4, 8, 16, ... words up to ``size``. A
  node of one suffix is a leaf and is dropped at once. Words are compared, not hashes of them.

Each slice of rows first settles its own repeats the same way, so a passage that stands in every
document leaves a slice once.

Order: ``doc_id`` (null last), then a 64-bit hash of the text, then the place in the text. Equal rows of one
doc_id are one document. Null and empty texts have no words and stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.words import BLANK, BitTable, Words, cut_words, give_back, hash_values, lean_slices, member, mix, rolled, sliding_min, spans, text_bytes
from tripleweave.plans.rounds import cut

#: Words of the prefix a window is filed under.
GRAM = 4
#: Texts handled at once by a task.
SLICE = 3 << 20
#: Bytes of text that one group receives on average, and how many a window takes in its piece.
GROUP_BYTES = 6 << 20
WINDOW_BYTES = 20
#: More windows than this, and more than one in 2**15 of all, lengthen a prefix; so 32 768 prefixes at most.
HOT_WINDOWS = 100_000
HOT_SHARE = 1 / (1 << 15)

_ROW = pa.schema(
    [("part", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("text", pa.binary())]
)
_HIT = "doc_id long, rk long, start long, n long"


def _plain(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("rk"), F.col(text).alias("text"))


def _words(column) -> Words:
    data, offsets = text_bytes(column)
    return cut_words(data, offsets, ~BLANK[data])


def _keys(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the prefix hash each is filed under, and the hash of the whole window."""
    if len(words.ids) < size:
        empty = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), empty, empty
    h = hash_values(words.values)[words.ids]
    whole = words.row[: len(h) - size + 1] == words.row[size - 1 :]
    at = np.flatnonzero(whole)
    gram = min(GRAM, size)
    least = sliding_min(mix(rolled(h, gram)), size - gram + 1)
    return at, least[at], mix(rolled(h, size)[at])


def _ranks(doc_id: pa.Array, rk: np.ndarray) -> np.ndarray:
    """Rank of each row in the order of documents; equal rows have one rank."""
    missing = doc_id.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(doc_id, 0).to_numpy()
    order = np.lexsort((rk, ids, missing))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(rk[order]) != 0) | (missing[order][1:] != missing[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def deep_nodes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Tree node of depth ``size`` of every suffix that starts in ``at``, -1 for those without a companion.

    The tree is grown level by level: a node of depth 2d is a node of depth d followed by another one, d words on.
    ``at`` holds starts with ``size`` words after them; ``ids`` are exact word numbers.
    """
    node = np.full(len(ids), -1, np.int64)
    # Words that begin no window still name the later levels of windows before them.
    inside = np.zeros(len(ids) + 1, np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, np.minimum(at + size, len(ids)), -1)
    used = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    node[used] = ids[used]
    depth = 1
    while depth < size:
        step = min(depth, size - depth)
        follow = used + step
        ok = follow < len(ids)
        ok[ok] = (node[used[ok]] >= 0) & (node[follow[ok]] >= 0)
        used = used[ok]
        code = node[used] * (int(node.max(initial=0)) + 1) + node[used + step]
        _, name, count = np.unique(code, return_inverse=True, return_counts=True)
        node = np.full(len(ids), -1, np.int64)
        kept = count[name] > 1
        used = used[kept]
        node[used] = name[kept]
        depth += step
    if size == 1:
        _, name, count = np.unique(node[used], return_inverse=True, return_counts=True)
        node[used] = np.where(count[name] > 1, name, -1)
    return node[at]


def _later(node: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which suffixes share a node with one of a smaller (rank, start)."""
    gone = np.zeros(len(node), bool)
    shared = np.flatnonzero(node >= 0)
    if not len(shared):
        return gone
    order = shared[np.lexsort((start[shared], rank[shared], node[shared]))]
    n, r, s = node[order], rank[order], start[order]
    first = np.ones(len(order), bool)
    first[1:] = n[1:] != n[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    gone[order] = (r != r[head]) | (s != s[head])
    return gone


def _runs(at: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First element and length of maximal runs of consecutive starts with one label."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (label[1:] != label[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def _starts_in_row(words: Words) -> np.ndarray:
    return np.arange(len(words.row)) - np.searchsorted(words.row, words.row, "left")


def _hits(words: Words, batch: pa.RecordBatch, at: np.ndarray, place: np.ndarray, groups: int) -> pa.RecordBatch:
    """Runs of repeated windows at word numbers ``at`` as rows of ``_ROW`` without key and text, for any group."""
    first, n = _runs(at, words.row[at])
    rows = pa.array(words.row[at[first]])
    part = np.arange(len(n)) % groups
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.nulls(len(n), pa.int64()), batch.column("doc_id").take(rows), batch.column("rk").take(rows),
         pa.array(place[at[first]]), pa.array(n), pa.nulls(len(n), pa.binary())], schema=_ROW)


def _pieces(batch: pa.RecordBatch, size: int, hot: np.ndarray, shared: BitTable, groups: int) -> Iterator[pa.RecordBatch]:
    """Of one slice: hits among its own rows, and pieces of text with the windows that may stand elsewhere too."""
    words = _words(batch.column("text"))
    at, key, window = _keys(words, size)
    if not len(at):
        return
    place = _starts_in_row(words)
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twins = np.sort(order[np.append(same, False) | np.append(False, same)])
    gone = np.zeros(len(at), bool)
    if len(twins):
        node = deep_nodes(words.ids, at[twins], size)
        rank = _ranks(batch.column("doc_id"), batch.column("rk").to_numpy())
        gone[twins] = _later(node, rank[words.row[at[twins]]], place[at[twins]])
        if gone.any():
            yield _hits(words, batch, at[gone], place, groups)
    sent = ~gone
    sent[sent] = shared.has(key[sent])
    at, key, window = at[sent], key[sent], window[sent]
    key = np.where(member(hot, key), window, key)
    first, n = _runs(at, key)
    last = at[first] + n - 1 + size - 1
    # A run may not cross rows: the windows before and after a row's end are never consecutive.
    part = (mix(key[first]) % np.uint64(groups)).astype(np.int32)
    begin, end = words.start[at[first]], words.end[last]
    _, inner = spans(end - begin)
    body = words.data[np.repeat(begin, end - begin) + inner]
    ends = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    text = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])
    rows = pa.array(words.row[at[first]])
    yield pa.RecordBatch.from_arrays(
        [pa.array(part), pa.array(key[first].view(np.int64)), batch.column("doc_id").take(rows), batch.column("rk").take(rows),
         pa.array(place[at[first]]), pa.array(n), text], schema=_ROW)


def _subtree(table: pa.Table, size: int) -> pa.RecordBatch | None:
    """Hits among the pieces of one group."""
    table = table.combine_chunks()
    key = table.column("key").to_numpy()
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    table = table.filter(pa.array(count[inverse] > 1)).combine_chunks()  # a slice sends a window once
    if not table.num_rows:
        return None
    words = _words(table.column("text"))
    n = table.column("n").to_numpy()
    begins = np.searchsorted(words.row, np.arange(table.num_rows), "left")
    piece, place = spans(n)
    at = begins[piece] + place
    node = deep_nodes(words.ids, at, size)
    doc_id = table.column("doc_id").combine_chunks()
    rank = _ranks(doc_id, table.column("rk").to_numpy())
    start = table.column("start").to_numpy()
    gone = _later(node, rank[piece], start[piece] + place)
    if not gone.any():
        return None
    first, length = _runs(at[gone], piece[gone])
    of = pa.array(piece[gone][first])
    return pa.RecordBatch.from_arrays(
        [doc_id.take(of), table.column("rk").combine_chunks().take(of),
         pa.array((start[piece] + place)[gone][first]), pa.array(length)], names=["doc_id", "rk", "start", "n"])


def prefix_counts(plain: DataFrame, size: int) -> DataFrame:
    """``(key, places, windows)`` of the prefixes that windows are filed under, over all rows.

    ``places`` counts runs of neighbouring windows, so it does not depend on how rows are dealt to tasks.
    """

    def count(batches):
        for part in lean_slices(batches, "text", SLICE):
            at, key, _ = _keys(_words(part.column(0)), size)
            first, n = _runs(at, key)
            keys, of, places = np.unique(key[first], return_inverse=True, return_counts=True)
            windows = np.bincount(of, weights=n, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(places), pa.array(windows)], names=["key", "places", "windows"])

    counted = plain.select("text").mapInArrow(count, "key long, places long, windows long")
    return counted.groupBy("key").agg(F.sum("places").alias("places"), F.sum("windows").alias("windows"))


def _shared_table(shared: DataFrame, expected: int) -> BitTable:
    """The keys as a bit table; its cells are put together by key range, 64 bits a row."""
    table = BitTable(expected)

    def cells(batches):
        for batch in batches:
            byte, bit = table.place(batch.column(0).to_numpy().view(np.uint64))
            shift = (byte & np.uint64(7)) * np.uint64(8)
            yield pa.RecordBatch.from_arrays([pa.array((byte >> np.uint64(3)).astype(np.int64)), pa.array((bit.astype(np.uint64) << shift).view(np.int64))], names=["cell", "bits"])

    rows = shared.select("key").mapInArrow(cells, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    table.table.view(np.int64)[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return table


def find_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, rk, start, n)``: windows ``start`` to ``start + n - 1`` of a row repeat an earlier one.

    ``rk`` is ``xxhash64(text)``; a row may have overlapping runs. An empty table gives an empty result.
    """
    if size < 1:
        raise ValueError("size must be at least one word")
    plain = _plain(docs, id_col, text)
    shared = cut(prefix_counts(plain, size).where(F.col("places") > 1), "prefixes")
    sums = shared.agg(F.count("*").alias("keys"), F.coalesce(F.sum("windows"), F.lit(0)).alias("windows")).first()
    limit = max(HOT_WINDOWS, int(sums["windows"] * HOT_SHARE))
    hot = shared.where(F.col("windows") > limit).select("key").toArrow()  # at most windows / limit rows
    hot = np.sort(hot.column("key").to_numpy().view(np.uint64))
    groups = int(sums["windows"] * WINDOW_BYTES / GROUP_BYTES) + 1
    sent = docs.sparkSession.sparkContext.broadcast(_shared_table(shared, sums["keys"]))

    def deal(batches):
        for batch in lean_slices(batches, "text", SLICE):
            yield from _pieces(batch, size, hot, sent.value, groups)

    def finish(table):
        local = table.filter(pc.is_null(table.column("key")))
        if local.num_rows:
            yield from local.select(["doc_id", "rk", "start", "n"]).combine_chunks().to_batches()
        found = _subtree(table.filter(pc.is_valid(table.column("key"))), size)
        if found is not None:
            yield found
        give_back()

    def grow(batches):
        kept = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]  # rows are sorted by group
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if kept and kept[-1].column("part")[0].as_py() != part[a]:
                        yield from finish(pa.Table.from_batches(kept))
                        kept = []
                    kept.append(batch.slice(a, b - a))
        if kept:
            yield from finish(pa.Table.from_batches(kept))

    schema = "part int, key long, doc_id long, rk long, start long, n long, text binary"
    dealt = plain.mapInArrow(deal, schema).repartition(groups, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(grow, _HIT)


def _gone(words: Words, runs: list[list[dict] | None], size: int) -> np.ndarray:
    """Words covered by any repeated window."""
    begins = np.searchsorted(words.row, np.arange(len(runs) + 1), "left")
    change = np.zeros(len(words.row) + 1, np.int64)
    for i, row in enumerate(runs):
        for run in row or ():
            change[begins[i] + run["start"]] += 1
            change[begins[i] + run["start"] + run["n"] + size - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_runs(docs: DataFrame, hits: DataFrame, id_col: str, text: str, keep: bool) -> DataFrame:
    """Each row with its runs; ``keep`` carries the whole row along under a name of its own."""
    found = hits.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "runs")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("rk"), F.col(text).alias("text"), *row)
    return plain.join(found, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("rk") == F.col("_rk")), "left").drop("_id", "_rk")


def _kept(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, bytes]]:
    """``(words, removed, kept words joined by a space)`` of every row."""
    words = _words(batch.column("text"))
    gone = _gone(words, batch.column("runs").to_pylist(), size)
    begins = np.searchsorted(words.row, np.arange(batch.num_rows + 1), "left")
    # Every kept word with one space after it, then cut per row without the last space.
    stay = np.flatnonzero(~gone)
    lengths = words.end[stay] - words.start[stay] + 1
    _, inner = spans(lengths)
    source = np.append(words.data, np.uint8(32))
    where = np.repeat(words.start[stay], lengths) + inner
    where[np.cumsum(lengths) - 1] = len(words.data)
    body = source[where].tobytes()
    ends = np.append(0, np.cumsum(lengths))
    edge = np.searchsorted(words.row[stay], np.arange(batch.num_rows + 1), "left")
    for i in range(batch.num_rows):
        a, b = ends[edge[i]], ends[edge[i + 1]]
        n = int(begins[i + 1] - begins[i])
        yield n, n - int(edge[i + 1] - edge[i]), body[a : max(b - 1, a)]


def digest(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row."""
    hits = cut(find_repeats(docs, size, id_col, text), "word_repeats")

    def work(batches):
        for batch in lean_slices(batches, "text", SLICE):
            rows = [(n, gone, hashlib.sha256(body).hexdigest()) for n, gone, body in _kept(batch, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = _with_runs(docs, hits, id_col, text, keep=False).select("doc_id", "text", "runs")
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_word_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words of repeated windows taken out of their texts.

    Texts that lose nothing stay as they are, null included; the others are their kept words joined by one space.
    Other columns stay, whatever their names.
    """
    hits = cut(find_repeats(docs, size, id_col, text), "word_repeats")
    joined = _with_runs(docs, hits, id_col, text, keep=True).select("row", "text", "runs")

    def work(batches):
        for batch in lean_slices(batches, "text", SLICE):
            old = batch.column("text").to_pylist()
            new = [o if not gone else body.decode() for o, (_, gone, body) in zip(old, _kept(batch, size))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "kept"])

    schema = joined.select("row", F.col("text").alias("kept")).schema
    changed = joined.mapInArrow(work, schema)
    return changed.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
