"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. Examples: a bounded, hash-ordered sample of the labelled rows (``max_examples`` rows, ``max_chars``
   code points; rows behind either bound are left out, no text is cut).
2. Terms: every word of the examples. Document frequencies are counted over all documents.
3. Weight of a term in a text: ``(1 + log tf) * idf * (1 + z^2)``, where z says by how many standard
   deviations toxic examples hold the term more often than all examples (0 if they do not). No term is left out.
4. The examples' unit vectors are an inverted index: a term's postings lie in blocks of examples, each with
   its largest weight. A query adds up what the most frequent terms give every example and bounds each block
   with the other terms' largest weights; it scores the blocks of the highest bounds, then all blocks whose
   bound reaches the k-th cosine found: the k nearest and their ties are exact.
5. Votes are weighted by the cosine; a monotone fit on the examples, each without itself (neither among
   its neighbours nor in the z of its terms), turns the vote into a probability.

Words that no example holds would scale all cosines of a text alike: order and votes do not depend on them, the
cosines of the evidence are those without them.

Defined cases: null and empty texts, and texts without any word of the examples, get the rate of such
examples, or of all examples if there is none; labels that are null, or of ids without a document, are not
used; a document labelled both ways counts as toxic; repeated rows are scored each by itself; examples that
tie with the k-th vote too; without labelled rows of both kinds every score is the known rate, or 0.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import id_text, slices
from tripleweave.plans.rounds import cut

MAX_EXAMPLES = 8192
#: Of all examples together; bounds the vocabulary and the index sent to the tasks.
MAX_CHARS = 1 << 26
NEAREST = 25
#: Examples of a block.
BLOCK = 128
#: Blocks that are scored before the others are judged by their bounds.
FIRST = 4
#: Terms whose lists are kept as rows over all examples, at most; changes the work, not the result.
FULL_TERMS = 1024
#: Texts scored together.
GROUP = 64
#: Scores kept per task for texts of equal counts; only saves time.
KEPT = 10_000
CUT = 0.3

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the length of each range."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths), lengths


class BlockMaxIndex:
    """Postings of unit vectors by term and block of examples, each block with its largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        """``vectors``: term numbers and weights of each example; neighbours in this order share blocks."""
        self.size, self.n_blocks = len(vectors), -(-len(vectors) // BLOCK)
        lengths = np.array([len(at) for at, _ in vectors], dtype=np.int64)
        term = np.concatenate([at for at, _ in vectors]) if vectors else np.zeros(0, np.int64)
        row = np.repeat(np.arange(self.size), lengths)
        order = np.lexsort((row, term))
        term, self.row = term[order], row[order].astype(np.int32)
        self.weight = (np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0))[order].astype(np.float32)
        key = term * max(1, self.n_blocks) + self.row // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block = (key[first] % max(1, self.n_blocks)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.postings = np.append(first, len(key))  # of a block entry
        self.entries = np.searchsorted(key[first] // max(1, self.n_blocks), np.arange(n_terms + 1))  # of a term

        held = np.diff(self.postings[self.entries])
        common = np.argsort(-held, kind="stable")[:FULL_TERMS]
        self.full = np.sort(common[held[common] * 32 >= self.size]) if self.size else np.zeros(0, np.int64)
        self.full_row = np.full(n_terms, -1, dtype=np.int32)
        self.full_row[self.full] = np.arange(len(self.full))
        self.rows = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rows": None}

    def _full_rows(self) -> np.ndarray:
        """The lists of the most frequent terms, which leave out few blocks, as rows over all examples."""
        if self.rows is None:
            self.rows = np.zeros((len(self.full), self.size))
            for row, term in enumerate(self.full.tolist()):
                at = slice(self.postings[self.entries[term]], self.postings[self.entries[term + 1]])
                self.rows[row, self.row[at]] = self.weight[at]
        return self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of the highest positive cosine and all that tie with the last of them; exact."""
        return next(self.nearest_each([(terms, weights, skip)], k))

    def nearest_each(self, queries: Iterable[tuple[np.ndarray, np.ndarray, int]], k: int) -> Iterator[list[tuple[float, int]]]:
        """``nearest`` of every ``(terms, weights, skip)``; frequent terms are added up for a group of queries at once."""
        rows = self._full_rows()
        for group in batched(queries, GROUP):
            dense = np.zeros((len(group), len(rows)))
            for i, (terms, weights, _) in enumerate(group):
                row = self.full_row[terms]
                dense[i, row[row >= 0]] = weights[row >= 0]
            base = dense @ rows
            for (terms, weights, skip), scores in zip(group, base, strict=True):
                rare = self.full_row[terms] < 0
                yield self._best(terms[rare], weights[rare], scores, k, skip)

    def _best(self, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """The best examples, given what the frequent terms add to the ``scores`` and the other terms."""
        if not self.size:
            return []
        entry, lengths = _ranges(self.entries[terms], self.entries[terms + 1])
        weight, block = np.repeat(weights, lengths), self.block[entry]
        bounds = np.maximum.reduceat(scores, np.arange(0, self.size, BLOCK)) + np.bincount(block, self.most[entry] * weight, self.n_blocks)

        def look(wanted: np.ndarray) -> float:
            held = wanted[block]
            at, n = _ranges(self.postings[entry[held]], self.postings[entry[held] + 1])
            scores[:] += np.bincount(self.row[at], self.weight[at] * np.repeat(weight[held], n), self.size)
            if skip >= 0:
                scores[skip] = -1.0
            return float(np.partition(scores, -k)[-k]) if self.size > k else 0.0

        first = np.zeros(self.n_blocks, dtype=bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        least = look(first)
        left = ~first & (bounds > 0) & (bounds >= least - 1e-6)
        if left.any():
            least = look(left)
        found = np.flatnonzero((scores > 0) & (scores >= least - 1e-9))
        found = found[np.lexsort((found, -scores[found]))]
        return list(zip(scores[found].tolist(), found.tolist(), strict=True))


def vote(found: list[tuple[float, int]], labels: np.ndarray) -> float | None:
    total = sum(s for s, _ in found)
    return round(sum(s * labels[i] for s, i in found) / total, 9) if total > 0 else None


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the highest vote of each pool and the pool's smoothed rate."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for value, label in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][2] == value:
            pools[-1][0] += label
            pools[-1][1] += 1
        else:
            pools.append([label, 1, value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            hits, n, top = pools.pop()
            pools[-1] = [pools[-1][0] + hits, pools[-1][1] + n, top]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def _arrays(counts: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers in order, and their counts."""
    if isinstance(counts, tuple):
        return counts
    at, n = np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))
    order = np.argsort(at)
    return at[order], n[order]


class Model:
    """What the tasks need: terms and their weights, the index, the examples' labels and the fitted rates."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, examples: list[tuple], k: int, no_vote: float):
        """``examples``: (id, label, counts), the counts as {term number: count} or as two arrays by term number."""
        self.words, self.idf, self.k, self.numbers = terms, idf, k, None
        self.toxic, self.held = np.zeros(len(terms)), np.zeros(len(terms))
        examples = [(i, label, _arrays(counts)) for i, label, counts in examples]
        self.n_toxic, self.n = float(sum(label for _, label, _ in examples)), float(len(examples))
        for _, label, (at, _) in examples:
            self.held[at] += 1
            self.toxic[at] += label
        without = [label for _, label, (at, _) in examples if not len(at)]
        self.no_vote = (sum(without) + 0.5) / (len(without) + 1) if without else no_vote
        known = [(*x, self.weigh(x[2])) for x in examples if len(x[2][0])]
        known.sort(key=lambda x: int(x[3][0][np.argmax(x[3][1])]))  # examples of one strongest term share blocks
        self.ids, self.labels = [x[0] for x in known], np.array([x[1] for x in known], dtype=float)
        self.index = BlockMaxIndex([x[3] for x in known], len(terms))
        known = [x[1:3] for x in known]
        queries = ((*self.weigh(counts, label), row) for row, (label, counts) in enumerate(known))
        found = [vote(x, self.labels) for x in self.index.nearest_each(queries, k)]
        self.index.rows = None
        votes, labels = [v for v in found if v is not None], [y for v, y in zip(found, self.labels, strict=True) if v is not None]
        self.tops, self.rates = monotone(np.array(votes), np.array(labels)) if votes else (np.zeros(0), np.zeros(0))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": b" ".join(self.words), "numbers": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, words=state["words"].split())

    def weigh(self, counts: dict[int, int] | tuple[np.ndarray, np.ndarray], own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights; ``own``: the label of an example whose counts are to be left out of z."""
        at, tf = _arrays(counts)
        toxic, held, n_toxic, n = self.toxic[at], self.held[at], self.n_toxic, self.n
        if own is not None:
            toxic, held, n_toxic, n = toxic - own, held - 1, n_toxic - own, n - 1
        rate, share = held / max(n, 1), n_toxic / max(n, 1)
        spread = np.sqrt(np.maximum(held * (1 - rate) * share * (1 - share), 1e-9))
        z = np.maximum(0, toxic - held * share) / spread
        weights = (1 + np.log(tf)) * self.idf[at] * (1 + np.where(held > 0, z, 0) ** 2)
        return at, weights / math.sqrt(float(weights @ weights))

    def count(self, text: str | None) -> dict[int, int]:
        if self.numbers is None:
            self.numbers = {t: i for i, t in enumerate(self.words)}
        get = self.numbers.get
        counts = Counter(map(get, words_of(text)))
        counts.pop(None, None)
        return counts

    def scores(self, texts: list[dict[int, int] | tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of every text, given by its counts."""
        texts = [_arrays(counts) for counts in texts]
        nearest = self.index.nearest_each(((*self.weigh(counts), -1) for counts in texts if len(counts[0])), self.k)
        for at, _ in texts:
            found = next(nearest) if len(at) else []
            v = vote(found, self.labels)
            if v is None or not len(self.tops):
                yield self.no_vote, found
            else:
                yield float(self.rates[min(int(np.searchsorted(self.tops, v)), len(self.tops) - 1)]), found


def _key(counts: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(counts[0].tobytes() + counts[1].tobytes(), digest_size=16).digest()


def vocabulary_of(examples: DataFrame) -> list[bytes]:
    """The distinct words of the bounded examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = sorted(set().union(*(words_of(t) for t in part.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["word"])

    return sorted(examples.select("text").mapInArrow(run, "word binary").distinct().toArrow().column("word").to_pylist())


def document_frequencies(texts: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """The number of rows of ``texts``, and of those that hold each term; one row per task and term is shuffled."""
    packed = b" ".join(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(packed.split())}
        counts, rows = np.zeros(len(number), dtype=np.int64), 0
        for part in slices(batches, "text"):
            for t in part.column("text").to_pylist():
                rows += 1
                at = [i for i in map(number.get, set(words_of(t))) if i is not None]
                counts[at] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()], pa.int32()), pa.array([rows, *counts[at].tolist()], pa.int64())], names=["term", "n"]
        )

    found = texts.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(len(terms) + 1)
    totals[found.column("term").to_numpy()] = found.column("n").to_numpy()  # term -1, the rows, comes last
    return int(totals[-1]), totals[:-1]


def counted(examples: DataFrame, terms: list[bytes], kind: str) -> list[tuple]:
    """``(doc_id, toxic, (term numbers, counts))`` of the bounded examples, in an order of their own."""
    packed = b" ".join(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(packed.split())}
        for part in slices(batches, "text"):
            found = [sorted((number[w], n) for w, n in Counter(words_of(t)).items()) for t in part.column("text").to_pylist()]
            lists = [pa.array([[x[side] for x in f] for f in found], pa.list_(pa.int32())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], names=["doc_id", "toxic", "at", "n"])

    rows = examples.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, at array<int>, n array<int>").toArrow()
    columns = [rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist()]
    arrays = zip(*([x.values.to_numpy() for x in rows.column(c)] for c in ("at", "n")), strict=True)
    return sorted(zip(*columns, arrays, strict=True), key=lambda x: (str(x[0]), x[2][0].tobytes(), x[2][1].tobytes()))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_examples: int = MAX_EXAMPLES,
    max_chars: int = MAX_CHARS, k: int = NEAREST,
) -> Model:
    """Fit on at most ``max_examples`` labelled rows of ``docs``; frequencies come from all of ``docs``.

    Labels without a document take no place in the sample. Equal rows of one doc_id are one example; an id with
    several labels is toxic if one of them says so. The sample ends before the row that brings it over ``max_chars``.
    """
    texts = id_text(docs, id_col, text)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = texts.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_at"), F.length("text").alias("_chars"))  # no text is shuffled
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_at")]
    sample = rows.join(known, "doc_id").distinct().orderBy(*by_hash).limit(max_examples)
    chars = F.sum(F.col("_chars").cast("long")).over(Window.orderBy(*by_hash))  # over max_examples rows of no text
    sample = cut(sample.withColumn("_sum", chars).where(F.col("_sum") <= max_chars).select("doc_id", "_at", "toxic"), "sample")
    found = texts.withColumn("_at", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "_at"])  # at most max_examples rows
    examples = cut(found.dropDuplicates(["doc_id", "_at"]).select("doc_id", "text", "toxic"), "examples")
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    rate = n_toxic / (n_toxic + n_clean) if sizes else 0.0
    terms = vocabulary_of(examples) if n_toxic and n_clean else []
    if not terms:
        return Model([], np.zeros(0), [], k, rate)
    everything, held = document_frequencies(texts, terms)
    idf = np.log((1 + everything) / (1 + held)) + 1
    return Model(terms, idf, counted(examples, terms, docs.schema[id_col].dataType.simpleString()), k, rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
    """``(doc_id, score, evidence)``; evidence: the nearest examples' ids, labels and cosines."""
    from_schema = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        kept: dict = {}
        for part in slices(batches, "text"):
            texts = [_arrays(model.count(t)) for t in part.column("text").to_pylist()]
            keys = [_key(counts) for counts in texts]
            new = {key: counts for key, counts in zip(keys, texts, strict=True) if key not in kept}
            now = {key: kept[key] for key in keys if key in kept}
            for key, (value, found) in zip(new, model.scores(list(new.values())), strict=True):
                now[key] = value, [
                    {"example": str(model.ids[i]), "toxic": int(model.labels[i]), "cosine": float(s)} for s, i in found[:evidence]
                ]
            scores, shown = [now[key][0] for key in keys], [now[key][1] for key in keys]
            kept = now if len(kept) > KEPT else {**kept, **now}
            kind = pa.list_(pa.struct([("example", pa.string()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(shown, kind)], names=["doc_id", "score", "evidence"])

    return id_text(docs, id_col, text).mapInArrow(
        run, f"doc_id {from_schema}, score double, evidence array<struct<example:string,toxic:int,cosine:double>>"
    )


def reject(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more; all columns stay."""

    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column(part.schema.names.index("text")).to_pylist()
            scores = model.scores([model.count(t) for t in texts])
            yield part.filter(pa.array([value < cut for value, _ in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
