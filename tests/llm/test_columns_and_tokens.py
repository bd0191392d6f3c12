"""Columns with clashing names, and token files against the library on whole texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tripleweave.llm import decontaminate, line_dedup, repeats, token_files
from tripleweave.llm.queries import tokenizer_file
from tripleweave.plans.rounds import new_path

CLASHING = ["_key", "_doc", "_gone", "spans", "_row", "_hits", "_doc_", "row_key", "doc_key", "hits", "lid"]


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "one line of text\n" + passage), (2, "one line of text\nother words " + passage), (3, None), (None, "x"), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("operator", ["lines", "repeats", "documents", "spans"])
def test_columns_of_any_name_come_back_as_they_were(spark, docs, monkeypatch, operator):
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(5, 20))), (2, "one two three")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    run = {
        "lines": line_dedup.dedup_lines, "repeats": repeats.remove_repeats,
        "documents": lambda d: decontaminate.decontaminate(d, bench), "spans": lambda d: decontaminate.decontaminate(d, bench, remove="spans"),
    }[operator]
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    out = run(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == texts(run(docs)) != texts(docs)
    assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHING)


def test_token_files_equal_the_library_on_whole_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    parts = ["the", "Straße", "naïve", "<|endoftext|>", "a<|startoftext|>b", "  ", "\n\n", " ", "12,5", "😀", "​", "Don't", "x" * 300, "<|ENDOFTEXT|>"]
    given = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    given += [(60, None), (61, ""), (62, "<|endoftext|>"), (63, " ".join(f"long{i % 991}" for i in range(30_000)))]
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in given:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    path = new_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame(given, "doc_id long, text string").repartition(3), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    assert sorted(map(tuple, token_files.token_offsets(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_offsets_follow_the_numbers_of_parts(spark):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    path = new_path(spark, "parts").removeprefix("file:")
    os.makedirs(path)
    for number, doc in ((99_999, 1), (100_000, 2)):
        kept = pa.table({"doc_id": pa.array([doc]), "n_tokens": pa.array([doc], pa.int32()), "ids": pa.array([[7] * doc], pa.list_(pa.int32()))})
        pq.write_table(kept, f"{path}/part-{number}-x.parquet")
    assert {r["doc_id"]: r["start"] for r in token_files.token_offsets(spark, path).collect()} == {1: 0, 2: 1}
