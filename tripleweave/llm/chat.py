"""Chat formatting from an event log.

A conversation is a log of events ``(conv_id, message, turn, seq, kind, role, text)``. A message
starts, grows by streamed deltas, is replaced by an edit, or dropped and written anew by a
regeneration. The log is partitioned by conversation and message and sorted by sequence; what
counts is what came since the last start, edit or regeneration. So a hot conversation is folded in
many tasks; only a caller that asks for the whole conversation as one string puts it in one row.

The template marks turns with ``<|turn|>role<|says|>text<|done|>``. Inside roles and texts every
``<`` + any number of ``~`` + ``|`` gets one more ``~``; no marker can then occur in them, and taking
one ``~`` away gives the text back. The loss mask of a message is a span of its piece.

Defined cases: null roles and texts are empty; rows of equal turns follow each other by role and
text, repeated rows stay; a null turn comes first; a null conv_id is a conversation of its own; a
conversation without assistant text has an empty loss mask; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: Kinds of events that discard what a message held before.
RESET = ["start", "edit", "regenerate"]
DELTA_CHARS = 2000


def escape(col: Column) -> Column:
    return F.regexp_replace(col, r"<(~*+)\|", r"<~$1|")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<~(~*+)\|", r"<$1|")


def as_events(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log that would have streamed the rows ``(conv_id, turn, role, text)``: a start, then deltas."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("message"),
    )
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    log = F.concat(
        F.array(F.struct(F.lit("start").alias("kind"), F.lit("").alias("text"))),
        F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("kind"), p.alias("text"))),
    )
    return rows.select("conv_id", "message", "turn", "role", F.posexplode(log).alias("seq", "event")).select(
        "conv_id", "message", "turn", F.col("seq").cast("long").alias("seq"), "event.kind", "role", "event.text"
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, message, role, text)``; the role is the last one given."""
    entry = F.struct("seq", F.col("kind").isin(RESET).alias("reset"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    messages = events.groupBy("conv_id", "message", "turn").agg(
        F.array_sort(F.collect_list(entry)).alias("log"), F.max(F.when(F.col("kind").isin(RESET), F.col("seq"))).alias("since")
    )
    live = F.filter("log", lambda e: F.col("since").isNull() | (e["seq"] >= F.col("since")))
    return messages.select(
        "conv_id", "turn", "message", F.element_at("log", -1)["role"].alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per message: its piece of the formatted conversation and the span under the loss mask."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    body = escape(F.col("text"))
    masked = F.col("role") == loss_role
    return messages.select(
        "conv_id", "turn", "role", "message", F.concat(head, body, F.lit(DONE)).alias("piece"),
        F.when(masked, F.length(head)).otherwise(0).alias("loss_start"), F.when(masked, F.length(body)).otherwise(0).alias("loss_chars"),
    )


def write_pieces(pieces: DataFrame, path: str) -> None:
    pieces.write.parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Read back: role and text parsed from each piece, and the text its loss mask covers."""
    rows = spark.read.parquet(path)
    parts = F.split("piece", r"<\|(?:turn|says|done)\|>", -1)
    return rows.select(
        "conv_id", "turn", "message", "piece", unescape(F.element_at(parts, 2)).alias("role"), unescape(F.element_at(parts, 3)).alias("text"),
        unescape(F.expr("substring(piece, loss_start + 1, loss_chars)")).alias("loss"),
        F.length("piece").cast("long").alias("chars"),
    )


def whole_conversations(pieces: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)``: the whole string and the loss spans in it, start and length in code points."""
    entry = F.struct("turn", "role", "message", "piece", "loss_start", "loss_chars", F.length("piece").alias("chars"))
    grouped = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("log", lambda e: e["piece"]), "").alias("formatted"),
        F.aggregate(
            "log", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,chars:int>>").alias("spans")),
            lambda acc, e: F.struct(
                (acc["at"] + e["chars"]).alias("at"),
                F.when(e["loss_chars"] > 0, F.concat(acc["spans"], F.array(F.struct((acc["at"] + e["loss_start"]).alias("start"), e["loss_chars"].alias("chars")))))
                .otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        ).alias("loss"),
    )


def digest(read: DataFrame) -> DataFrame:
    """Per conversation: digests of its turns and of the text under the loss mask. A digest needs its whole conversation."""
    entry = F.struct("turn", "role", "text", "message", "loss", "chars")
    grouped = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(entry)).alias("log"), F.sum("chars").alias("formatted_chars"),
        F.sum(F.length("loss")).cast("long").alias("loss_chars"),
    )
    turns = F.array_join(F.transform("log", lambda e: F.concat(e["role"], F.lit("\n"), e["text"], F.lit("\n"))), "")
    return grouped.select(
        "conv_id", F.size("log").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), "loss_chars",
        F.sha2(F.array_join(F.transform("log", lambda e: e["loss"]), ""), 256).alias("loss_sha256"), "formatted_chars",
    )
