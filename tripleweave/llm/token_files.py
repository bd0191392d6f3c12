"""Token ids in Parquet: one list column, encoded and paged for selective reads.

Documents are ordered by doc_id over the files, then encoded by the tokenizers library. Ids are a
list of 32-bit integers: dictionary pages, or delta packing (format 2) where a dictionary grows too
large; row groups and pages are small, and the page indexes that the writer adds let a reader of few
documents or of the metadata alone skip the rest.

White space separates words before any merge and gives no ids itself, so every white-space piece is
encoded once by the library and its ids are kept in a bounded cache of the Python worker.

Names of special tokens in a text give their ids, as the library does it by default.

Defined cases: null is the empty text and holds the end id alone; repeated doc_ids stand side by
side in text order, each row by itself; a null doc_id comes first; an empty table writes files
without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import id_text, over_texts

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1000
CACHE_HALF = 150_000

_made: dict[int, _Encoder] = {}


class _Encoder:
    """White-space pieces -> ids as bytes, by the library's tokenizer."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.pieces = regex.compile(r"[^\p{White_Space}]+").findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        lists = [self.pieces(t) if t else [] for t in texts]
        young = self.young
        new = {w for x in lists for w in x if w not in young}
        carried = {w: self.old[w] for w in new if w in self.old}
        fresh = list(new - carried.keys())
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for word, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                carried[word] = np.array(coded.ids, "<u4").tobytes()
        young.update(carried)
        out = [b"".join([young[w] for w in x]) for x in lists]
        if len(young) > CACHE_HALF:
            self.old, self.young = young, {}
        return out


def _encoder(definition: str) -> _Encoder:
    key = zlib.crc32(definition.encode())
    if key not in _made:
        _made[key] = _Encoder(definition)
    return _made[key]


def encode_documents(docs: DataFrame, definition: str, end_id: int | None) -> DataFrame:
    """``(doc_id, n_tokens, ids)``; ``definition`` is the tokenizer's JSON."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        coded = [x + end for x in _encoder(definition).encode(part.column("text").to_pylist())]
        ends = np.cumsum([0] + [len(x) // 4 for x in coded])
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
            names=["doc_id", "n_tokens", "ids"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_texts(docs, work, f"doc_id {kind}, n_tokens int, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text: str = "text"
) -> None:
    """Encode ``docs`` into token files at ``path``, in ascending doc_id order over the files and inside them."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    ordered = id_text(docs, id_col, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        encode_documents(ordered, definition, end_id)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The written rows; only the named columns are read."""
    return spark.read.parquet(path).select(*(columns or ["doc_id", "n_tokens", "ids"]))


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` in file order, from the files alone."""
    rows = spark.read.parquet(path).select(
        "doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")
    )

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("at"), pa.array(counts), pa.array(crcs, pa.int64())],
                names=["doc_id", "file", "at", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(run, f"doc_id {kind}, file string, at long, n_tokens long, ids_crc32 long")
    meta = spark.read.parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("file"))
    # numbers of parts follow the order of ranges, names only up to five digits; one row per file here
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = meta.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return read.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "file").select(
        "doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32"
    )
