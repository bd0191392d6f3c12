"""Registration and the SQL fragments several families share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.sources.records import spread


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register


TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


SPLIT = r"[^\p{L}\p{N}]+"


def sql_words(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '{SPLIT}'), lambda t: t <> '')"


def sql_tokens(expr: str) -> str:
    return f"list_distinct({sql_words(expr)})"


def sql_qgrams(expr: str, q: int = 3) -> str:
    chars = f"string_split({expr}, '')"
    shifted = ", ".join([chars] + [f"({chars})[{i}:]" for i in range(2, q + 1)])
    joined = " || ".join(f"z[{i}]" for i in range(1, q + 1))
    return (
        f"(case when length({expr}) >= {q} then list_transform(list_zip({shifted}, true), lambda z: {joined}) "
        f"when length({expr}) > 0 then [{expr}] else [] end)"
    )
