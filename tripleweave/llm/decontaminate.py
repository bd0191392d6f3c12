"""Benchmark decontamination by a broadcast set of normalised n-grams.

Every item gives the windows of ``n`` consecutive words it holds; an item of fewer words is one
window. The windows, as word numbers, are handed to the tasks in blocks of bounded size; each task
numbers its words by the block's vocabulary, rolls a hash over runs of known words, looks it up and
compares the words themselves. With one block, the usual case, no row is shuffled; with more, each
block is one scan and the findings of a document are merged by its row.

Defined cases: null and word-less texts have no words and are never hit; items without words have
no window; equal items are reported together; repeated document rows are judged each by itself; an
empty benchmark leaves every document clean; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.common import id_text, slices, unused
from tripleweave.llm.line_dedup import small
from tripleweave.plans.rounds import cut

N_WORDS = 10
#: Words of items held by a task at once; more items make more blocks.
BLOCK_WORDS = 2_000_000

#: Bytes of words: 0-9, a-z and all of a multi-byte character; A-Z count as a-z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

FOUND = "row long, doc_id {id}, n_words long, hits array<struct<first:long,past:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class WindowSet:
    """The windows of a block of items: by length, hash of the word numbers -> windows and their items."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - n + 1) if ids else 0):
                owners[tuple(ids[i : i + n])].add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        sizes = {len(w) for w in owners}
        for size in sizes:
            table: dict[int, list] = defaultdict(list)
            for w, found in owners.items():
                if len(w) == size:
                    table[int(self.roll(np.array(w, dtype=np.uint64), size)[0])].append((w, found))
            self.by_length[size] = np.sort(np.array(list(table), dtype=np.uint64)), dict(table)

    @classmethod
    def roll(cls, ids: np.ndarray, size: int) -> np.ndarray:
        """A hash of each ``size`` neighbouring numbers."""
        out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = out * cls.BASE + ids[k : len(ids) - size + 1 + k]
            out ^= out >> np.uint64(29)
        return out

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, length, items) of each occurrence; number 0 is an unknown word."""
        for size, (keys, table) in self.by_length.items():
            if len(ids) < size:
                continue
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            hashes = np.zeros(len(at), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(size):
                    hashes = hashes * self.BASE + ids[at + k]
                hashes ^= hashes >> np.uint64(29)
            near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            for i, h in zip(at[keys[near] == hashes[:]].tolist(), hashes[keys[near] == hashes].tolist(), strict=True):
                seen = tuple(ids[i : i + size].tolist())
                for window, found in table[h]:
                    if window == seen:
                        yield i, size, found


def _scanner(items: list[tuple[str, str | None]], n: int):
    made: list[WindowSet] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(WindowSet(items, n))
        windows = made[0]
        number = windows.number
        for part in slices(batches, "text"):
            lists = [words_of(t) for t in part.column("text").to_pylist()]
            starts = np.cumsum([0] + [len(x) + 1 for x in lists])
            ids = np.zeros(int(starts[-1]), dtype=np.uint64)  # a 0 after each text
            for at, words in zip(starts.tolist(), lists, strict=False):
                if words:
                    ids[at : at + len(words)] = [number.get(w, 0) for w in words]
            hits: list[list] = [[] for _ in lists]
            found: list[set[str]] = [set() for _ in lists]
            for i, size, items_hit in windows.search(ids):
                row = int(np.searchsorted(starts, i, "right")) - 1
                hits[row].append((i - int(starts[row]), i - int(starts[row]) + size))
                found[row] |= items_hit
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array(
                        [[{"first": a, "past": b} for a, b in merged(x)] for x in hits],
                        pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])),
                    ),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ],
                names=["row", "doc_id", "n_words", "hits", "items"],
            )

    return run


def merged(spans: list) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(doc_id, n_words, hits, items)``: word spans under windows, items with an occurring window."""
    numbered = id_text(docs, id_col, text).withColumn("row", F.lit(0).cast("long"))
    sized = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")
    ).where("item IS NOT NULL AND text IS NOT NULL")
    # a word and its separator are two characters at least
    total = sized.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, int(np.ceil(total / block_words)))
    schema = FOUND.format(id=docs.schema[id_col].dataType.simpleString())
    if blocks == 1:
        return numbered.mapInArrow(_scanner([tuple(r) for r in sized.collect()], n), schema).drop("row")
    # A hash of the item deals the blocks; each block is collected and scanned by itself.
    numbered = numbered.withColumn("row", F.monotonically_increasing_id())
    scans = []
    for k in range(blocks):
        block = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        scans.append(numbered.mapInArrow(_scanner([tuple(r) for r in block.collect()], n), schema))
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionAll(scan)
    merged_spans = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("hits"))),
        F.array().cast("array<struct<first:long,past:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["past"] >= x["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["past"], x["past"]).alias("past"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), merged_spans.alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).drop("row")


def n_hit_words(hits="hits"):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["past"] - x["first"])


def digest(found: DataFrame) -> DataFrame:
    """Per document: words, hit words, items and whether it is contaminated."""
    hit = n_hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _plain(part: pa.RecordBatch) -> pa.RecordBatch:
    """Only what a scan reads, whatever other columns are called; a slice stays one slice."""
    return pa.RecordBatch.from_arrays(
        [part.column("text"), part.column("doc_id"), pa.array([0] * part.num_rows, pa.int64())], names=["text", "doc_id", "row"]
    )


def _without(texts: list, hits: list) -> list:
    """The texts less their hit spans."""
    import regex

    word = regex.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    out = []
    for text, spans in zip(texts, hits, strict=True):
        if spans:
            at = [m.span() for m in word.finditer(text)]
            kept, last = [], 0
            for s in spans:
                kept.append(text[last : at[s["first"]][0]])
                last = at[s["past"] - 1][1]
            text = "".join([*kept, text[last:]])
        out.append(text)
    return out


def _span_cutter(names, hits_of):
    def run(batches):
        for part in slices(batches, "text"):
            texts = _without(part.column("text").to_pylist(), hits_of(part))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else part.column(x) for x in names], names=names)

    return run


def _in_blocks(docs: DataFrame, benchmark: DataFrame, remove: str, max_hit_share: float, n: int, block_words: int) -> DataFrame:
    """As ``decontaminate``, a scan per block: rows are numbered once, and the findings of all blocks meet by number."""
    row, hits = unused(docs, "_row", "_hits")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = find_contamination(numbered, benchmark, n, id_col=row, block_words=block_words)
    if remove != "spans":
        gone = cut(found.where(n_hit_words() > F.lit(max_hit_share) * F.col("n_words")).select(F.col("doc_id").alias(row)), "contaminated")
        return numbered.join(small(gone), row, "left_anti").select(*docs.columns)
    spans = cut(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(row), F.col("hits").alias(hits)), "hits")
    rows = numbered.join(small(spans), row, "left").select(*docs.columns, hits)
    return rows.mapInArrow(_span_cutter(docs.columns, lambda part: part.column(hits).to_pylist()), docs.schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", max_hit_share: float = 0.0, n: int = N_WORDS
) -> DataFrame:
    """``docs`` without contaminated documents (more than ``max_hit_share`` of the words hit), or without the hit spans.

    ``remove="spans"`` cuts the text from the first to the last hit word of each span. All columns stay.
    A benchmark beyond one block (``BLOCK_WORDS``) is scanned block by block; the hits of all blocks count together.
    """
    sized = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    if (sized.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0) > BLOCK_WORDS:
        return _in_blocks(docs, benchmark, remove, max_hit_share, n, BLOCK_WORDS)
    scan = _scanner([tuple(r) for r in sized.collect()], n)
    if remove == "spans":
        return docs.mapInArrow(_span_cutter(docs.columns, lambda part: next(scan(iter([_plain(part)]))).column("hits").to_pylist()), docs.schema)

    def run(batches):
        for part in slices(batches, "text"):
            found = next(scan(iter([_plain(part)]))).to_pydict()
            keep = [
                sum(s["past"] - s["first"] for s in hits) <= max_hit_share * words
                for hits, words in zip(found["hits"], found["n_words"], strict=True)
            ]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
