"""Collocations of two to five words per language, by best-first branch and bound.

A phrase scores ``1000 * a * n / (l * r)`` at its weakest cut, with ``a`` its count, ``l`` and ``r`` those of the parts
and ``n`` the words of its language. The part beside the first word is at least as frequent as the phrase, and so is the part
before the last one; so no growth of a prefix scores above ``1000 * n / f(first word)``, and none that ends in a
word above ``1000 * n / f(last word)``. The frontier is opened in the order of that bound, rarest words first:

1. words are counted; those of ``least`` occurrences are the roots;
2. a round opens the words of the next band of counts (each ``BAND`` times as wide as the last) of every language
   that is not settled, counts all phrases whose ends are open words, at least one of them new, and drops those under ``least``;
3. phrases whose bound is below the language's last surviving score are cut off; the parts of the others are counted;
4. a language is settled once its ``top``-th surviving score is above the bound of all words still closed, so
   that not even a tie is left outside.

A candidate is dropped if a longer one that holds it is as frequent. Then one that is a word longer is, and that means all
its occurrences have one word before, or after, them; this is seen while counting (neighbours are compared
by 64-bit hashes).

Open words and wanted parts go to the tasks as sets of hashes, at most ``BLOCK`` at a time, one scan of the texts per block;
the other end of a phrase is tested on a bit table of bounded size. Both only choose what is counted:
counts are kept per phrase text, and ends are checked on exact word counts afterwards.

Null texts are empty, null languages ``und``. Repeated rows count again. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.words import BitTable, Words, byte_class, cut_words, hash_values, lean_slices, member, mix, rolled, spans, text_bytes
from tripleweave.plans.rounds import cut, top_per_group

#: Texts handled at once by a task.
SLICE = 3 << 20
#: Hashes sent to the tasks at once; more are sent in several blocks.
BLOCK = 1_000_000
#: Upper end of a band of word counts over its lower end.
BAND = 4

_SPACE = byte_class(b" \t")
_BREAK = byte_class(b".,;:!?\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Slice:
    """Words of a batch with their piece and a dense number per (language, word)."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("text"))
        data = _LOWER[data]
        breaks = _BREAK[data]
        self.words: Words = cut_words(data, offsets, ~(breaks | _SPACE[data]))
        w = self.words
        passed = np.cumsum(breaks)
        # A piece is named by its row and the marks passed before it.
        piece = passed[w.start] if len(w.start) else np.zeros(0, np.int64)
        self.new_piece = np.ones(len(w.start), bool)
        self.new_piece[1:] = (np.diff(w.row) != 0) | (np.diff(piece) != 0)
        coded = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        self.langs = coded.dictionary
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.row]
        code = w.ids * max(len(self.langs), 1) + lang
        size = len(w.values) * len(self.langs)
        if size <= 8 * len(code) + 1024:
            used = np.zeros(size, bool)
            used[code] = True
            self.distinct = np.flatnonzero(used)
            self.code = (np.cumsum(used) - 1)[code]
        else:
            self.distinct, self.code = np.unique(code, return_inverse=True)
        self.lang = self.distinct % max(len(self.langs), 1)
        self.value = self.distinct // max(len(self.langs), 1)
        self.hash = word_hashes(hash_values(w.values)[self.value], hash_values(self.langs.cast(pa.large_binary()))[self.lang])

    def left_in_piece(self) -> np.ndarray:
        """How many words the piece still has at each word, itself included."""
        n = len(self.code)
        ends = np.append(np.flatnonzero(self.new_piece)[1:], n)
        return np.repeat(ends, np.diff(np.append(np.flatnonzero(self.new_piece), n))) - np.arange(n)


def word_hashes(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mix(words + mix(langs))


def hashes_of(langs: pa.Array, phrases: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole phrases and of their first words, as tasks compute them."""
    data, offsets = text_bytes(phrases)
    w = cut_words(data, offsets, data != 32)
    coded = langs.dictionary_encode()
    of_lang = hash_values(coded.dictionary.cast(pa.large_binary()))[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    h = word_hashes(hash_values(w.values)[w.ids], of_lang[w.row])
    first = np.searchsorted(w.row, np.arange(len(phrases)), "left")
    size = np.diff(np.append(first, len(h)))
    out = h[first].copy()
    for m in np.unique(size):
        if m > 1:
            out[size == m] = mix(rolled(h, int(m))[first[size == m]])
    return out, h[first]


_COUNTS = "lang string, phrase string, n long, rows long, lefts long, left_min long, left_max long, rights long, right_min long, right_max long"


def _texts(s: Slice, at: np.ndarray, m: int) -> pa.Array:
    """The ``m`` words from each start, joined by a space."""
    w = s.words
    word = (at[:, None] + np.arange(m)).ravel()
    lengths = w.end[word] - w.start[word] + 1
    _, inner = spans(lengths)
    where = np.repeat(w.start[word], lengths) + inner
    stops = np.cumsum(lengths)
    where[stops - 1] = len(w.data)
    drop = np.ones(len(where), bool)
    drop[stops[m - 1 :: m] - 1] = False
    body = np.append(w.data, np.uint8(32))[where[drop]]
    ends = np.append(0, stops[m - 1 :: m] - np.arange(1, len(at) + 1)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])


def _counted(s: Slice, starts: np.ndarray, longest: int, wanted) -> "list[pa.RecordBatch]":
    """Phrases from ``starts`` that ``wanted(m, first positions)`` chooses, with counts and common neighbours."""
    left = s.left_in_piece()
    at, name, out = np.flatnonzero(starts[s.code] & (left > 1)), None, []
    name = s.code[at]
    for m in range(2, longest + 1):
        ok = left[at] >= m
        at, name = at[ok], name[ok]
        if not len(at):
            break
        _, first, name, n = np.unique(name * len(s.distinct) + s.code[at + m - 1], return_index=True, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(wanted(m, at[first]))
        if not len(chosen):
            continue
        rank = np.full(len(first), -1)
        rank[chosen] = np.arange(len(chosen))
        of = rank[name]
        here, of = at[of >= 0], of[of >= 0]
        columns = []
        for neighbour, there in ((here - 1, ~s.new_piece[here]), (here + m, left[here] > m)):
            mark = np.where(there, s.code[np.clip(neighbour, 0, len(s.code) - 1)], -1)
            low, high = np.full(len(chosen), len(s.distinct)), np.full(len(chosen), -2)
            np.minimum.at(low, of, mark)
            np.maximum.at(high, of, mark)
            one = (low == high) & (low >= 0)
            value = pa.array(np.where(one, s.hash[np.maximum(np.where(one, low, 0), 0)].view(np.int64), 0), mask=~one)
            columns += [pa.array(one.astype(np.int64)), value, value]
        lang = s.langs.take(pa.array(s.lang[s.code[at[first[chosen]]]]))
        out.append(pa.RecordBatch.from_arrays(
            [lang.cast(pa.string()), _texts(s, at[first[chosen]], m).cast(pa.string()), pa.array(n[chosen]), pa.array(np.ones(len(chosen), np.int64)), *columns],
            names=[c.split()[0] for c in _COUNTS.split(", ")],
        ))
    return out


def _count(plain: DataFrame, longest: int, choose) -> DataFrame:
    """``(lang, phrase, n, held)`` of what ``choose(slice)`` names: start flags per code and a test of phrases.

    ``held``: every occurrence has one and the same word before it, or after it.
    """

    def run(batches):
        for batch in lean_slices(batches, "text", SLICE):
            s = Slice(batch)
            if len(s.code):
                starts, wanted = choose(s)
                yield from _counted(s, starts, longest, wanted)

    counts = plain.mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows"),
        F.sum("lefts").alias("lefts"), F.min("left_min").alias("l0"), F.max("left_max").alias("l1"),
        F.sum("rights").alias("rights"), F.min("right_min").alias("r0"), F.max("right_max").alias("r1"),
    )
    held = F.expr("(rows = lefts AND l0 = l1) OR (rows = rights AND r0 = r1)")
    return counts.select("lang", "phrase", "n", F.coalesce(held, F.lit(False)).alias("held"))


def word_counts(plain: DataFrame) -> DataFrame:
    def run(batches):
        for batch in lean_slices(batches, "text", SLICE):
            s = Slice(batch)
            if len(s.code):
                n = np.bincount(s.code, minlength=len(s.distinct))
                words = s.words.values.take(pa.array(s.value)).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(s.lang)).cast(pa.string()), words, pa.array(n)], names=["lang", "word", "f"])

    return plain.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _blocks(table: DataFrame, column: str):
    """Hashes of ``(lang, column)`` rows, at most about ``BLOCK`` rows at a time."""
    blocks = table.count() // BLOCK + 1
    for b in range(blocks):
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("lang", column), F.lit(blocks)) == b)
        rows = part.select("lang", column).toArrow().combine_chunks()
        if rows.num_rows:
            yield hashes_of(*(rows.column(c).combine_chunks() for c in ("lang", column)))


def _open_phrases(plain: DataFrame, opened: BitTable, new: np.ndarray, done: np.ndarray, longest: int) -> DataFrame:
    """Phrases with open ends, one of them in ``new``; none that an earlier block of the round (``done``) has."""

    def choose(s: Slice):
        open_, fresh, seen = opened.has(s.hash), member(new, s.hash), member(done, s.hash)

        def wanted(m, first):
            a, b = s.code[first], s.code[first + m - 1]
            return (fresh[a] | fresh[b]) & (open_[a] & open_[b]) & ~(seen[a] | seen[b])

        return open_, wanted

    return _count(plain, longest, choose)


def _wanted_phrases(plain: DataFrame, phrases: np.ndarray, firsts: np.ndarray, longest: int) -> DataFrame:
    phrases, firsts = np.unique(phrases), np.unique(firsts)

    def choose(s: Slice):
        h = s.hash[s.code]

        def wanted(m, first):
            return member(phrases, mix(rolled_at(h, first, m)))

        return member(firsts, s.hash), wanted

    return _count(plain, longest, choose)


def rolled_at(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """:func:`rolled` at some starts only."""
    wide = h[at[:, None] + np.arange(m)].ravel()
    return rolled(wide, m)[::m]


def _score(cuts: DataFrame) -> DataFrame:
    """Lowest score over the cuts of a phrase; products are taken in decimals."""
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    exact = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), whole("l") * whole("r"))
    lowest = F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("_c")
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest).select("lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score")


def _scored(plain: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``; ``candidates`` has ``(lang, phrase, a, n, f1, fm)``."""
    words = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = candidates.select("*", k).select(
        "lang", "phrase", "a", "n", "f1", "fm", "k",
        F.when(F.col("k") > 1, part(F.lit(1), F.col("k"))).alias("head"),
        F.when(F.col("k") < F.size(words) - 1, part(F.col("k") + 1, F.size(words) - F.col("k"))).alias("rest"),
    )
    parts = cuts.select("lang", F.explode(F.array("head", "rest")).alias("part")).where("part IS NOT NULL").distinct()
    parts = cut(parts, "phrase_parts")
    counted = None
    for phrases, firsts in _blocks(parts, "part"):
        found = _wanted_phrases(plain, phrases, firsts, 4).select("lang", F.col("phrase").alias("part"), F.col("n").alias("c"))
        found = cut(found.join(parts, ["lang", "part"], "left_semi"), "part_counts")
        counted = found if counted is None else counted.unionAll(found)
    if counted is None:
        ready = cuts.withColumn("l", F.col("f1")).withColumn("r", F.col("fm"))
    else:
        head = counted.select("lang", F.col("part").alias("head"), F.col("c").alias("l"))
        rest = counted.select("lang", F.col("part").alias("rest"), F.col("c").alias("r"))
        ready = cuts.join(head, ["lang", "head"], "left").join(rest, ["lang", "rest"], "left")
        ready = ready.withColumn("l", F.coalesce("l", "f1")).withColumn("r", F.coalesce("r", "fm"))
    return _score(ready)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` best phrases of every language."""
    if not 2 <= longest <= 5 or least < 1:
        raise ValueError("phrases have two to five words and occur at least once")
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = cut(word_counts(plain), "word_counts")
    sizes = cut(counts.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    band = F.floor(F.log(float(BAND), F.col("f") / F.lit(float(least))) + F.lit(1e-9)).cast("int")
    words = cut(counts.where(F.col("f") >= least).withColumn("band", band), "words")
    # One row per language and band.
    bands: dict[str, dict[int, tuple[int, int]]] = {}
    for row in words.groupBy("lang", "band").agg(F.count("*").alias("c"), F.min("f").alias("low")).collect():
        bands.setdefault(row["lang"], {})[row["band"]] = (row["c"], row["low"])
    n_of = {r["lang"]: r["n"] for r in sizes.collect()}
    expected = sum(c for b in bands.values() for c, _ in b.values())
    opened, best, last = BitTable(expected), None, {}
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for b in sorted({k for of in bands.values() for k in of}):
        active = [g for g, of in bands.items() if any(k >= b for k in of)]
        # Settled: nothing that is still closed can reach the last place.
        active = [g for g in active if g not in last or 1000 * n_of[g] // min(low for k, (_, low) in bands[g].items() if k >= b) >= last[g]]
        if not active:
            break
        bounds = cut(spark.createDataFrame([(g, last.get(g, 0)) for g in active], "lang string, floor long"), "bounds")
        texts = plain.join(bounds.select("lang"), "lang", "left_semi")  # settled languages are not read again
        batch = words.where(F.col("band") == b).join(bounds.select("lang"), "lang", "left_semi")
        blocks = []
        for hashes, _ in _blocks(batch, "word"):
            opened.add(hashes)
            blocks.append(np.sort(hashes))
        found = None
        for i, new in enumerate(blocks):
            done = np.sort(np.concatenate(blocks[:i])) if i else np.zeros(0, np.uint64)
            phrases = cut(_open_phrases(texts, opened, new, done, longest).where(F.col("n") >= least), "phrases")
            found = phrases if found is None else found.unionAll(phrases)
        if found is None:
            continue
        # Phrases of the full length have no longer candidate that could hold them.
        survives = ~F.col("held") | (F.size(F.split("phrase", " ")) == longest)
        first = words.select("lang", F.col("word").alias("_w1"), F.col("f").alias("f1"), F.col("band").alias("b1"))
        final = words.select("lang", F.col("word").alias("_wm"), F.col("f").alias("fm"), F.col("band").alias("bm"))
        ends = found.where(survives).select("lang", "phrase", F.col("n").alias("a"), F.element_at(F.split("phrase", " "), 1).alias("_w1"), F.element_at(F.split("phrase", " "), -1).alias("_wm"))
        ends = ends.join(first, ["lang", "_w1"]).join(final, ["lang", "_wm"]).where(F.greatest("b1", "bm") == b)
        ends = ends.join(sizes, "lang").join(bounds, "lang")
        bound = F.expr("cast(1000 as decimal(4,0)) * cast(n as decimal(18,0)) div greatest(f1, fm)")
        kept = cut(ends.where(bound >= F.col("floor")).select("lang", "phrase", "a", "n", "f1", "fm"), "candidates")
        scored = _scored(texts, kept)
        everything = scored if best is None else best.unionByName(scored)
        best = cut(top_per_group(everything, ["lang"], order, F.lit(top), ["phrase"]), "best")
        full = best.groupBy("lang").agg(F.count("*").alias("c"), F.min("score").alias("low")).where(F.col("c") >= top)
        last = {r["lang"]: r["low"] for r in full.collect()}
    if best is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rank = F.row_number().over(_by_lang(order)).cast("long")  # at most ``top`` rows a language
    return best.withColumn("rank", rank).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _by_lang(order):
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(*order)
