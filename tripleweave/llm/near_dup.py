"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

1. One pass over the texts gives each document's set of word shingles as 64-bit hashes, its size,
   a digest of the set, the minima of ``bands * rows`` universal hash functions and the band keys.
   Documents with equal sets form a class and take part once.
2. In every bucket (band, key) the members are paired with a pivot. The bands use four orders of
   the classes, so one group of near copies meets several pivots; a bucket of m gives m - 1 pairs.
3. Pairs whose signatures agree too little are left out (the margin is over five standard
   deviations); the others are confirmed on the full sets, streamed past their pivot's set.
4. Where a bucket still holds several components, the members outside its largest one are paired
   with every member of another component: no pair that shares a bucket stays undecided. Pairs are
   listed for small buckets only (a bounded number per member); the members of large ones are
   compared block against block inside tasks, which return links.
5. Components by large-star and small-star; a document's component is its least doc_id.

Defined cases: null and word-less texts have the empty set and stay alone; fewer words than a
shingle make one shingle; repeated rows of a doc_id join what any of them is linked with; a null
doc_id takes part, and a component of such rows alone has the component null. At a similarity of
0.8 the default 36 bands of 6 miss a pair with probability 2e-5, above it with less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import id_text, slices
from tripleweave.llm.graph import components
from tripleweave.plans.rounds import cut

BANDS, ROWS = 36, 6
#: Signatures may fall short of the similarity by this much: 5.5 standard deviations at 0.8.
MARGIN = 0.15
#: Members that are sent past one copy of a pivot's set.
PIVOT_SHARE = 512
#: Undecided buckets of up to so many members list their pairs; the members of larger ones are compared in blocks.
LISTED = 32
#: Members of a block.
CHUNK = 256
#: Fixed random masks: the orders in which pivots are the first of their bucket.
ORDERS = [0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    """Word -> 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(28)
    return h


def shingle_sets(texts: list[str | None], size: int, words: _Words) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes of its lower-cased words."""
    lists = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() if t else [] for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    ends = np.cumsum(counts)
    flat = np.fromiter((words[w] for x in lists for w in x), dtype=np.uint64, count=int(counts.sum()))
    out = []
    with np.errstate(over="ignore"):
        factors = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0xD6E8FEB8) for k in range(size)]
        rolled = np.zeros(max(0, len(flat) - size + 1), dtype=np.uint64)
        for k in range(size):
            rolled *= factors[k]
            rolled += flat[k : len(flat) - size + 1 + k]
        rolled = mix(rolled)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= size:
                out.append(np.unique(rolled[end - n : end - size + 1]))
            elif n:
                h = np.full(1, n, dtype=np.uint64)
                for w in flat[end - n : end]:
                    h = h * factors[1] + w
                out.append(mix(h))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def _universal(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


SIGNED = "doc_id {id}, row_key long, n_shingles long, cid long, sig binary, bands array<long>"


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, row_key, n_shingles, cid, sig, bands)``: the set's digest, a byte of each minimum, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        a, b = _universal(bands * rows)
        for part in slices(batches, "text", 1 << 20):
            sets = shingle_sets(part.column("text").to_pylist(), size, words)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = sizes > 0
            minima = np.zeros((len(sets), bands * rows), dtype=np.uint32)
            cids = np.zeros(len(sets), dtype=np.uint64)
            if full.any():
                flat = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[full]
                with np.errstate(over="ignore"):
                    for j in range(bands * rows):
                        minima[full, j] = np.minimum.reduceat((flat * a[j] + b[j]) >> np.uint64(32), starts)
                    cids[full] = np.add.reduceat(mix(flat * np.uint64(0xC2B2AE3D27D4EB4F)), starts)
                    keys = np.zeros((len(sets), bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::rows])
            else:
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
            low = minima.astype(np.uint8)
            keys = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(cids.view(np.int64), pa.int64(), mask=~full),
                    pa.array([x.tobytes() if f else None for x, f in zip(low, full, strict=True)], pa.binary()),
                    pa.array([x if f else [] for x, f in zip(keys.tolist(), full, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_key", "n_shingles", "cid", "sig", "bands"],
            )

    return docs.mapInArrow(run, SIGNED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in a share of at least ``least``."""
    with_sigs = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b"
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                one = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("sig_a", "sig_b")]
                keep = pa.array((one[0] == one[1]).mean(axis=1) >= least)
                yield part.select(["a", "b"]).filter(keep)

    return with_sigs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def packed(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in raw]


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int, as_sets: Callable[[list[bytes]], list[np.ndarray]] = packed) -> DataFrame:
    """Pairs with 100 * intersection >= threshold * union of the full sets, which ``as_sets`` makes from ``hashes``.

    The members of a pivot are dealt to shares; the pivot's set is sent once to each share and held
    while the members' sets stream past it.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_SHARE).alias("n"))
    members = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).alias("share"), "b")
    rows = members.join(sets.select(F.col("cid").alias("b"), "hashes"), "b").select("a", "share", "b", "hashes").unionAll(
        shares.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("share"))
        .join(sets.select(F.col("cid").alias("a"), "hashes"), "a")
        .select("a", "share", F.lit(None).cast("long").alias("b"), "hashes")
    )
    ordered = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches):
        pivot, held = None, None
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                out = []
                sets_here = as_sets(part.column("hashes").to_pylist())
                for a, b, mine in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), sets_here, strict=True):
                    if b is None:
                        pivot, held = a, mine
                    elif a == pivot:
                        near = np.searchsorted(held, mine)
                        near[near == len(held)] = 0
                        common = int((held[near] == mine).sum())
                        if 100 * common >= threshold * (len(held) + len(mine) - common):
                            out.append((a, b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"]
                )

    return ordered.mapInArrow(run, "a long, b long")


def _sets_of(texts: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(cid, hashes)`` of the wanted classes, from the text of each class's first document."""
    chosen = classes.join(wanted.distinct(), "cid").select("cid", "doc_id", "row_key")
    rows = texts.alias("t").join(chosen.alias("c"), F.expr("t.row_key = c.row_key AND t.doc_id <=> c.doc_id"))

    def run(batches):
        words = _Words()
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), size, words)
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "hashes"])

    return rows.select("cid", "text").mapInArrow(run, "cid long, hashes binary").dropDuplicates(["cid"])


def crowds_of(undecided: DataFrame) -> DataFrame:
    """``(cid, root, crowd, n)``: members of large undecided buckets; buckets that share a member are one crowd."""
    roots = components(undecided.select(F.col("cid").alias("u"), F.col("pivot").alias("v")))
    members = undecided.select("cid", "root").distinct().join(
        roots.select(F.col("node").alias("cid"), F.col("root").alias("crowd")), "cid"
    )
    return members.join(members.groupBy("crowd").agg(F.count("*").alias("n")), "crowd")


def crowd_links(
    crowds: DataFrame, sets: DataFrame, classes: DataFrame, threshold: int, least: float, as_sets: Callable[[list[bytes]], list[np.ndarray]] = packed
) -> DataFrame:
    """Links between different components of a crowd, found block against block.

    A crowd is dealt to chunks of ``CHUNK`` members; a task holds two chunks, compares signatures,
    confirms what is alike on the full sets, and returns links only. No pair is listed.
    """
    dealt = crowds.withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    spread = dealt.select("crowd", "cid", "root", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    rows = (
        spread.select("crowd", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "cid", "root")
        .join(classes.select("cid", "sig"), "cid").join(sets, "cid")
        .select("crowd", "i", "j", "chunk", "cid", "root", "sig", "hashes")
    )
    ordered = rows.repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j", "chunk", "cid")

    def compare(block: list[tuple]) -> list[tuple[int, int]]:
        sigs = np.frombuffer(b"".join(x[4] for x in block), np.uint8).reshape(len(block), -1)
        chunk, root = np.array([x[1] for x in block]), np.array([x[3] for x in block])
        held = as_sets([x[5] for x in block])
        sizes = np.array([len(x) for x in held])
        same_chunk = block[0][0][1] == block[0][0][2]
        out = []
        for at in range(len(block) - 1):
            later = slice(at + 1, len(block))
            near = (root[later] != root[at]) & (100 * np.minimum(sizes[later], sizes[at]) >= threshold * np.maximum(sizes[later], sizes[at]))
            if not same_chunk:
                near &= chunk[later] != chunk[at]
            found = np.flatnonzero(near) + at + 1
            if len(found):
                found = found[(sigs[found] == sigs[at]).mean(axis=1) >= least]
            for k in found.tolist():
                where = np.searchsorted(held[at], held[k])
                where[where == sizes[at]] = 0
                common = int((held[at][where] == held[k]).sum())
                if 100 * common >= threshold * (int(sizes[at] + sizes[k]) - common):
                    out.append((block[at][2], block[k][2]))
        return out

    def run(batches):
        key, block = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("crowd", "i", "j", "chunk", "cid", "root", "sig", "hashes")), strict=True):
                if row[:3] != key:
                    out += compare(block) if block else []
                    key, block = row[:3], []
                block.append((key, *row[3:]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        out = compare(block) if block else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row; ``threshold`` in hundredths of Jaccard similarity."""
    texts = id_text(docs, id_col, text)
    texts = texts.withColumn("row_key", F.xxhash64("text"))
    signed = cut(signatures(texts, size, bands, rows), "signatures")
    least = max(0.0, threshold / 100 - MARGIN)
    # the rows of a class have equal signatures and keys
    classes = cut(
        signed.where("cid IS NOT NULL").groupBy("cid")
        .agg(F.min(F.struct("doc_id", "row_key")).alias("k"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .select("cid", "k.*", "sig", "bands"),
        "classes",
    )
    keyed = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    mask = F.element_at(F.array(*[F.lit(m) for m in ORDERS]), (F.col("band") % len(ORDERS) + 1).cast("int"))
    keyed = keyed.select("cid", "key", mask.alias("mask"))
    # One pass: a join would meet the exploded keys again, which Spark sizes too low and may broadcast.
    bucket, turned = Window.partitionBy("key"), F.col("cid").bitwiseXOR(F.col("mask"))
    members = (
        keyed.select("key", "cid", "mask", F.min(turned).over(bucket).alias("first"), F.max(turned).over(bucket).alias("last"))
        .where("first <> last").select("key", F.col("first").bitwiseXOR(F.col("mask")).alias("pivot"), "cid")
    )
    members = cut(members, "members")
    pairs = members.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    pairs = cut(_alike(pairs, classes, least), "pairs")
    sets = cut(_sets_of(texts, classes, pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))), size), "sets")
    links = cut(confirmed(pairs, sets, threshold), "links")
    same_id = (
        signed.where("cid IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cid").alias("u"), F.max("cid").alias("v"), F.collect_set("cid").alias("s"))
        .where("u <> v").select("u", F.explode("s").alias("v"))
    )
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Buckets that hold several components: what is outside the largest meets the other components.
    placed = members.join(found.select(F.col("node").alias("cid"), "root"), "cid", "left").select(
        "key", "pivot", "cid", F.coalesce("root", "cid").alias("root")
    )
    placed = cut(placed, "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_buckets = parts.groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("roots")
    ).where("roots > 1 AND members > 2").select("key", F.col("top.root").alias("main"), "members")
    undecided = cut(placed.join(open_buckets, "key"), "undecided")
    small = undecided.where(F.col("members") <= LISTED)
    outside = small.where("root <> main").select("key", F.col("cid").alias("a"), F.col("root").alias("root_a"))
    rest = small.select("key", F.col("cid").alias("b"), "root", "main")
    more = (
        outside.join(rest, "key").where("root <> root_a AND (root = main OR a < b)")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(_alike(more.join(known, ["a", "b"], "left_anti"), classes, least), "more_pairs")
    crowds = cut(crowds_of(undecided.where(F.col("members") > LISTED)), "crowds")
    lacking = more.select(F.col("a").alias("cid")).unionAll(more.select(F.col("b").alias("cid"))).unionAll(crowds.select("cid")).distinct()
    lacking = lacking.join(sets.select("cid"), "cid", "left_anti")
    if not lacking.isEmpty():
        sets = sets.unionAll(cut(_sets_of(texts, classes, lacking, size), "sets"))
    if not more.isEmpty():
        links = links.unionAll(cut(confirmed(more, sets, threshold), "links"))
    if not crowds.isEmpty():
        links = links.unionAll(cut(crowd_links(crowds, sets, classes, threshold, least), "links"))
    found = components(
        found.select(F.col("node").alias("u"), F.col("root").alias("v"))
        .unionAll(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        .unionAll(same_id)
    )
    labelled = signed.select("doc_id", "n_shingles", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
        "doc_id", "n_shingles", "cid", F.coalesce("root", "cid").alias("root")
    )
    labelled = cut(labelled, "labelled")
    first = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    first = first.where("n > 1 OR component_id IS NULL").drop("n")
    return labelled.join(first, "root", "left").select(
        "doc_id", "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
