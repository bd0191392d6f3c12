"""Words that differ by one edit, by composing the vocabulary's acceptor with a one-edit transducer and itself.

* **Vocabulary.** Runs of letters of whole texts, counted; one run in 97 of a document's words loses a letter
  (a fixed rule on ids, see :func:`vocabulary`).
* **Partitions.** A near pair agrees before and after its edit. With ``cls`` the length of its shorter word, the
  place of the edit lies in ``[0, cls // 2)`` or ``[cls // 2, cls]``, so a word is filed under the half it must
  share, once per class it can belong to. A partition with more than ``CROWD`` words is halved again, down to
  a single place, where the alphabet bounds it.
* **Composition.** In a partition what lies between the shared ends is made into a minimised acceptor whose arcs
  carry word counts, so a path's sum is the number of its word. The composition's states are pairs of acceptor
  states with "edit still to come" (both equal) or "edit done"; the edit is taken at the first difference only,
  so each pair is enumerated once, in one partition. Acceptors of many partitions are worked through together,
  each from its own initial state.

Lengths are in code points. A null or empty text has no words. Rows may repeat; each counts. A null doc_id is
written ``None`` in the rule. Ties are broken by code-point order, which is that of UTF-8.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.common import slices
from tripleweave.llm.words import byte_class, cut_words, mix, spans, text_bytes
from tripleweave.plans.rounds import cut

#: Texts handled at once by a task, rows of partitions worked through together, composed states held at once.
SLICE = 8 << 20
ROWS = 60_000
STATES = 1_000_000
#: Words above which a partition is halved. Its number follows from what a task holds; results are the same.
CROWD = 50_000

_LETTERS = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lead byte of U+00C0 to U+00FF, all of them and no others.
_LEAD = 0xC3
#: Words up to so many bytes are checked by tables, longer ones one by one.
_TABLED = 48
_LABEL = 1 << 21


def _crc_shifts() -> np.ndarray:
    """``[length, byte, value]``: what a checksum becomes once ``length`` more bytes follow, apart from those bytes' own sum."""
    table = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    out = np.zeros((_TABLED + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_TABLED):
        out[n + 1] = table[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """``(word, n)`` of all runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased.

    Where ``every`` divides the crc32 of ``<id>:<run>``, the code point at crc32 modulo its length is deleted.
    """
    shifts = _crc_shifts()

    def count(batches):
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column("text"))
            after_lead = np.append(False, data[:-1] == _LEAD) if len(data) else np.zeros(0, bool)
            words = cut_words(_LOWER[data], offsets, _LETTERS[data] | (data == _LEAD) | after_lead)
            if not len(words.ids):
                continue
            values = words.values.cast(pa.large_string())
            sizes = pc.binary_length(words.values).to_numpy()
            crc = np.array([zlib.crc32(w) for w in words.values.to_pylist()], np.uint32)
            heads = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
            size, head = np.minimum(sizes[words.ids], _TABLED), heads[words.row]
            h = crc[words.ids]
            for k in range(4):
                h = h ^ shifts[size, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
            long = np.flatnonzero(sizes[words.ids] > _TABLED)
            for i in long:
                h[i] = zlib.crc32(words.data[words.start[i] : words.end[i]].tobytes(), int(head[i]))
            changed = h % every == 0
            shorter = Counter()
            for i, at in zip(words.ids[changed].tolist(), h[changed].tolist()):
                word = values[i].as_py()
                at %= len(word)
                shorter[word[:at] + word[at + 1 :]] += 1
            n = np.bincount(words.ids[~changed], minlength=len(values))
            yield pa.RecordBatch.from_arrays([values.cast(pa.string()), pa.array(n)], names=["word", "n"])
            if shorter:
                yield pa.RecordBatch.from_arrays([pa.array(list(shorter), pa.string()), pa.array(list(shorter.values()), pa.int64())], names=["word", "n"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(count, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


# --- partitions ------------------------------------------------------------------------


def _filed(words: DataFrame) -> DataFrame:
    """Every word once per class it can belong to and half that may hold the edit: places ``[a, b)``."""
    cls = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("cls")
    half = F.floor(F.col("cls") / 2).cast("int")
    places = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("cls") + 1).alias("b"))))
    return words.select("word", "n", cls).withColumn("_p", places).select("word", "n", "cls", "_p.a", "_p.b")


def _shared() -> F.Column:
    """What the words of a partition share, with its class and places."""
    tail = F.greatest(F.col("cls") - F.col("b"), F.lit(0))
    return F.concat_ws("|", "cls", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.right("word", tail))


def partitions(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(word, n, cls, a, b, shared)``, no partition above ``crowd`` words unless it has a single place."""
    filed = _filed(words).withColumn("shared", _shared())
    while True:
        crowds = filed.where("b - a > 1").groupBy("shared").count().where(F.col("count") > crowd).select("shared", F.lit(True).alias("_big"))
        crowds = cut(crowds, "crowds")
        if crowds.isEmpty():
            return filed
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        marked = filed.join(crowds, "shared", "left")
        parts = F.when(F.col("_big"), F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))
        parts = F.explode(F.coalesce(parts, F.array(F.struct("a", "b"))))
        filed = marked.withColumn("_p", parts).select("word", "n", "cls", "_p.a", "_p.b").withColumn("shared", _shared())
        filed = cut(filed, "partitions")


# --- acceptor and composition ----------------------------------------------------------


class Acceptor:
    """Minimised acceptor of sorted words, with one initial state per root.

    ``roots[i]`` is the root of word ``i``; words are sorted by root and code points and distinct within one.
    States are numbered by height, arcs of a state are sorted by label. ``skip`` of an arc counts the words that
    come before those through it, so the skips along a path add up to the word's place within its root.
    """

    def __init__(self, roots: np.ndarray, points: np.ndarray, lengths: np.ndarray):
        begins = np.cumsum(lengths) - lengths
        n_roots = int(roots[-1]) + 1
        node, total = roots.astype(np.int64), n_roots
        parents, labels, childs, finals = [], [], [], []
        alive, depth = np.arange(len(roots)), 0
        while len(alive):
            done = lengths[alive] == depth
            finals.append(node[alive[done]])
            alive = alive[~done]
            if not len(alive):
                break
            label = points[begins[alive] + depth].astype(np.int64)
            code = node[alive] * _LABEL + label
            new = np.append(True, code[1:] != code[:-1])
            child = total + np.cumsum(new) - 1
            parents.append(node[alive[new]])
            labels.append(label[new])
            childs.append(child[new])
            total = int(child[-1]) + 1
            node[alive] = child
            depth += 1
        none = [np.zeros(0, np.int64)]
        parent, label, child = (np.concatenate(x or none) for x in (parents, labels, childs))
        final = np.zeros(total, bool)
        final[np.concatenate(finals or none)] = True
        height = np.zeros(total, np.int64)
        for p, c in zip(reversed(parents), reversed(childs)):
            np.maximum.at(height, p, height[c] + 1)
        self._minimise(parent, label, child, final, height, n_roots)

    def _minimise(self, parent, label, child, final, height, n_roots):
        """Merge nodes with equal futures, from the leaves up: a node is its final flag and its labelled arcs."""
        state = np.zeros(len(final), np.int64)
        first = np.searchsorted(parent, np.arange(len(final) + 1))
        order = np.argsort(height, kind="stable")
        edges = np.searchsorted(height[order], np.arange(int(height.max(initial=0)) + 2))
        self.final, self.words = np.zeros(len(final), bool), np.zeros(len(final), np.int64)
        degrees, arc_labels, arc_to, skips, n_states = [], [], [], [], 0
        for h in range(len(edges) - 1):
            nodes = order[edges[h] : edges[h + 1]]
            degree = first[nodes + 1] - first[nodes]
            owner, place = spans(degree)
            arcs = first[nodes][owner] + place
            code = (label[arcs] * (len(final) + 1) + state[child[arcs]]).astype(np.uint64)
            marks = []
            for salt in (0x51ED270B9F3C5A77, 0xC2B2AE3D27D4EB4F):  # 128 bits name a future
                sums = np.zeros(len(nodes), np.uint64)
                np.add.at(sums, owner, mix(mix(code + np.uint64(salt)) ^ np.uint64(salt)))
                marks.append(sums + final[nodes].astype(np.uint64) * np.uint64(salt))
            by = np.lexsort(marks)
            new = np.append(True, (marks[0][by][1:] != marks[0][by][:-1]) | (marks[1][by][1:] != marks[1][by][:-1]))
            state[nodes[by]] = n_states + np.cumsum(new) - 1
            kept = by[new]
            owner, place = spans(degree[kept])
            arcs = first[nodes[kept]][owner] + place
            to = state[child[arcs]]
            flag = final[nodes[kept]]
            passed = np.cumsum(self.words[to]) - self.words[to]
            lead = (np.cumsum(degree[kept]) - degree[kept])[degree[kept] > 0]
            start = np.zeros(len(kept), np.int64)
            start[degree[kept] > 0] = passed[lead]
            skips.append(passed - start[owner] + flag[owner])
            new_states = slice(n_states, n_states + len(kept))
            self.final[new_states] = flag
            np.add.at(self.words[new_states], owner, self.words[to])
            self.words[new_states] += flag
            degrees.append(degree[kept])
            arc_labels.append(label[arcs])
            arc_to.append(to)
            n_states += len(kept)
        self.final, self.words = self.final[:n_states], self.words[:n_states]
        self.degree = np.concatenate(degrees)
        self.first = np.cumsum(self.degree) - self.degree
        self.label, self.to, self.skip = (np.concatenate(x) for x in (arc_labels, arc_to, skips))
        self.code = np.repeat(np.arange(n_states), self.degree) * _LABEL + self.label
        self.roots = state[:n_roots]

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``states`` and which arc, for all their arcs."""
        owner, place = spans(self.degree[states])
        return owner, self.first[states][owner] + place

    def find(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Arc with this label, -1 without one."""
        if not len(self.code):
            return np.full(len(states), -1)
        code = states * _LABEL + labels
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, at, -1)


def one_edit_pairs(acceptor: Acceptor, limits: np.ndarray):
    """Arrays ``(i, j, inserted)`` of word numbers a single edit apart, each unordered pair once.

    ``limits`` says per root before which depth the edit must lie. With ``inserted`` the second word has one more letter.
    """
    a = acceptor
    sizes = a.words[a.roots]
    state, index, limit = a.roots, np.cumsum(sizes) - sizes, limits
    depth = 0
    while len(state):
        open_ = limit > depth
        s, i = state[open_], index[open_]
        owner, arc = a.arcs(s)
        to, at = a.to[arc], i[owner] + a.skip[arc]
        # Insertion: the longer word goes on through an arc, the shorter one stays and must not take the same letter next.
        yield from _follow(a, s[owner], i[owner], to, at, a.label[arc], True)
        # Replacement: two different arcs of one state, the earlier with each later one.
        place = arc - a.first[s][owner]
        later = a.degree[s][owner] - place - 1
        step = max(1, STATES // int(later.max(initial=0) + 1))
        for lo in range(0, len(arc), step):
            left, k = spans(later[lo : lo + step])
            left += lo
            yield from _follow(a, to[left], at[left], to[left + k + 1], at[left + k + 1], None, False)
        owner, arc = a.arcs(state)
        state, index, limit = a.to[arc], index[owner] + a.skip[arc], limit[owner]
        depth += 1


def _follow(a: Acceptor, p, i, q, j, barred, inserted: bool):
    """Run pairs of states over their common letters; ``barred`` letters may not come first."""
    work = [(p[k : k + STATES], i[k : k + STATES], q[k : k + STATES], j[k : k + STATES], None if barred is None else barred[k : k + STATES]) for k in range(0, len(p), STATES)]
    while work:
        p, i, q, j, barred = work.pop()
        both = a.final[p] & a.final[q]
        if both.any():
            yield i[both], j[both], inserted
        # Arcs of the state with fewer of them are looked up in the other.
        swap = a.degree[q] < a.degree[p]
        small, large = np.where(swap, q, p), np.where(swap, p, q)
        owner, arc = a.arcs(small)
        ok = np.ones(len(arc), bool) if barred is None else a.label[arc] != barred[owner]
        owner, arc = owner[ok], arc[ok]
        other = a.find(large[owner], a.label[arc])
        ok = other >= 0
        owner, arc, other, swap = owner[ok], arc[ok], other[ok], swap[owner[ok]]
        if len(owner):
            left, right = np.where(swap, other, arc), np.where(swap, arc, other)
            nxt = (a.to[left], i[owner] + a.skip[left], a.to[right], j[owner] + a.skip[right])
            work.extend((*[x[k : k + STATES] for x in nxt], None) for k in range(0, len(owner), STATES))


def _near(table: pa.Table) -> pa.RecordBatch | None:
    """Near words of all partitions in ``table``, whole and sorted: count and best of each row that has any."""
    table = table.combine_chunks()
    word, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    cls, a, b = (table.column(c).to_numpy().astype(np.int64) for c in ("cls", "a", "b"))
    shared = table.column("shared").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    length = pc.utf8_length(word).to_numpy().astype(np.int64)
    inner = pc.utf8_length(table.column("inner")).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(table.column("inner").to_pylist()).encode("utf-32-le"), np.uint32)
    first = np.flatnonzero(np.append(True, shared[1:] != shared[:-1]))
    limits = np.where(b > cls, 1 << 40, b - a)[first]
    order = np.empty(len(n), np.int64)
    order[np.lexsort((pc.rank(word, sort_keys="ascending", tiebreaker="dense").to_numpy(), -n))] = np.arange(len(n))
    at_rank = np.argsort(order)
    count, best = np.zeros(len(n), np.int64), np.full(len(n), len(n), np.int64)
    for i, j, inserted in one_edit_pairs(Acceptor(shared, points, inner), limits):
        # Words of class + 1 among each other belong to the next class.
        ok = length[i] == cls[i]
        i, j = i[ok], j[ok]
        for x, y in ((i, j), (j, i)):
            np.add.at(count, x, 1)
            np.minimum.at(best, x, order[y])
    found = np.flatnonzero(count)
    if not len(found):
        return None
    top = pa.array(at_rank[best[found]])
    return pa.RecordBatch.from_arrays([word.take(pa.array(found)), pa.array(count[found]), pa.array(n[at_rank[best[found]]]), word.take(top)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``(word, n)`` that have near words; words are distinct."""
    filed = partitions(words, crowd)
    tail = F.greatest(F.col("cls") - F.col("b"), F.lit(0))
    inner = F.substring("word", F.col("a") + 1, F.char_length("word") - F.col("a") - tail)
    rows = filed.select("word", "n", "cls", "a", "b", "shared", inner.alias("inner"))

    def run(batches):
        kept = None
        for batch in batches:
            kept = pa.table(pa.Table.from_batches([batch])) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if kept.num_rows < ROWS:
                continue
            shared = kept.column("shared")
            last = shared[-1]
            whole = int(pc.sum(pc.not_equal(shared, last)).as_py() or 0)  # rows are sorted
            if whole >= ROWS // 2:
                found = _near(kept.slice(0, whole))
                kept = kept.slice(whole)
                if found is not None:
                    yield found
        if kept is not None and kept.num_rows:
            found = _near(kept)
            if found is not None:
                yield found

    sorted_ = rows.repartition("shared").sortWithinPartitions("shared", "inner")
    parts = sorted_.mapInArrow(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_f")).select("word", "n_near", (-F.col("_f.m")).alias("best_n"), "_f.best")


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)``: where the links of ``(word, form)`` end, by doubling the links followed each round.

    A word links to at most one other and links never close a circle (a form is twice as frequent).
    """
    now = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        now = cut(now.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), "roots")
        if now.where("_moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, id_col: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of words of ``shortest`` code points that occur ``least`` times.

    ``form`` is the most frequent near word if that is at least twice as frequent; ``root`` follows forms to the last.
    """
    if shortest < 4:
        raise ValueError("shorter words have no half to be filed under")
    words = cut(vocabulary(docs, id_col, text).where((F.char_length("word") >= shortest) & (F.col("n") >= least)), "vocabulary")
    near = near_words(words, crowd)
    is_form = F.col("best_n") >= 2 * F.col("n")
    formed = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
