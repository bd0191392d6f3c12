"""Byte-level BPE encoding and decoding over a rank file, with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte tokens. Every neighbouring pair that has a rank sits in the
bucket of that rank; a bitmap over the ranks, with two summary levels of 64 bits each, gives the
lowest rank by find-first-set. An entry whose pair has changed meanwhile is stale and skipped. So a
pre-token of n bytes takes O(n log n) steps, however long it is. Ids of pre-tokens are kept in a
cache of bounded size per Python worker; it only saves time.

Defined cases: null is the empty text, with no ids; repeated rows are encoded each by itself; an id
outside the ranks can't be decoded and raises.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tripleweave.llm.common import id_text, over_texts

#: Entries of either half of the pre-token cache.
CACHE_HALF = 200_000


class RankQueue:
    """Buckets of positions by rank; three bitmap levels of 64 bits find the lowest rank."""

    def __init__(self):
        self.top = 0
        self.mid: dict[int, int] = {}
        self.low: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[group] = self.mid.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def pop(self) -> tuple[int, int]:
        """The leftmost position of the lowest rank."""
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            self.low[word] &= self.low[word] - 1
            if not self.low[word]:
                self.mid[group] &= self.mid[group] - 1
                if not self.mid[group]:
                    self.top &= self.top - 1
        return rank, position


class ByteBpe:
    """The ranks of one file; ``encode`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.whole = {t: np.array([r], "<u4").tobytes() for t, r in self.ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        n = len(piece)
        end = list(range(1, n + 1))  # of the token that starts here; 0 once it was merged away
        before = list(range(-1, n - 1))
        waiting = [-1] * n  # the rank under which the pair that starts here was queued last
        queue = RankQueue()

        def look(at: int) -> None:
            following = end[at]
            waiting[at] = -1
            if following < n and (rank := ranks.get(piece[at : end[following]])) is not None:
                waiting[at] = rank
                queue.push(rank, at)

        for i in range(n - 1):
            look(i)
        while queue.top:
            rank, at = queue.pop()
            if waiting[at] != rank or not end[at]:
                continue  # stale
            gone = end[at]
            end[at], end[gone] = end[gone], 0
            if end[at] < n:
                before[end[at]] = at
            look(at)
            if before[at] >= 0:
                look(before[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def _piece(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            raw = text.encode("utf-8")
            ids = self.whole.get(raw) or np.array(self.merge(raw), "<u4").tobytes()
        if len(self.young) >= CACHE_HALF:
            self.old, self.young = self.young, {}
        if len(text) <= 64:
            self.young[text] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        young, piece = self.young.get, self._piece
        out = []
        for part in self.split(text):
            ids = young(part)
            if ids is None:
                ids = piece(part)
                young = self.young.get
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[tuple[int, str], ByteBpe] = {}


def codec(rank_file: bytes, pattern: str) -> ByteBpe:
    """One per Python worker and rank file."""
    key = zlib.crc32(rank_file), pattern
    if key not in _made:
        _made[key] = ByteBpe(rank_file, pattern)
    return _made[key]


def _lists(coded: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit ids over one buffer."""
    ends = np.cumsum([0] + [len(x) // 4 for x in coded]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``; the rank file is read here, on the driver, and sent with the tasks."""
    with open(rank_path, "rb") as f:
        rank_file = f.read()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(rank_file, pattern)
        ids = _lists([bpe.encode(t) for t in part.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return over_texts(id_text(docs, id_col, text), work, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` to ``(doc_id, bytes)``; a null list is the empty text."""
    with open(rank_path, "rb") as f:
        rank_file = f.read()

    def run(batches):
        bpe = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return tokens.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode, then decode those ids, in one pass: counts and digests of both, and the ids if wanted."""
    with open(rank_path, "rb") as f:
        rank_file = f.read()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(rank_file, pattern)
        ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
        columns = {
            "doc_id": part.column("doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
        }
        if with_ids:
            columns["ids"] = _lists(ids)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return over_texts(id_text(docs, id_col, text), work, schema + (", ids array<int>" if with_ids else ""))
